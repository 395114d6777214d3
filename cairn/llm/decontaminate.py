"""Passages of a benchmark in documents, by SimHash windows of the items' sizes (operator 5).

A document's words make runs of five (shingles). For every item, windows of as many shingles as the item has slide over the
document and get a fingerprint each. Fingerprints within RADIUS bits of an item's are found by a multi-index: the 64 bits
are cut into BLOCKS blocks, and two fingerprints within RADIUS bits agree within RADIUS // BLOCKS bits in one block at least,
so the tables of all such block values miss none. Each candidate window is then verified by the exact similarity of the two
weighted shingle sets (a shingle weighs as often as it occurs): the sum of smaller weights over that of larger ones.

Only windows that hold a shingle of some item need a fingerprint: without a common shingle the similarity is zero.

An item of fewer than five words is one shingle of all its words: it is like a window of a document only if the window has the
same words, so all runs of that many words are looked up.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import tokens
from cairn.llm.shared import saved, slices

#: Words of a shingle and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Differing bits of candidates (windows of a similarity of 0.8 differ in 10 on average, in more than 19 in one of 2,000 cases) and blocks.
RADIUS, BLOCKS = 19, 5
#: Shingles of an item's window at most; a longer item is looked for by each of its parts of that size.
LARGEST = 250
#: Characters and items of a benchmark that are broadcast at once; a larger benchmark is taken in as many passes as it needs. The
#: tables of a pass take 5 kB for each item and 41 kB for each size of windows, so 95 MB at most.
PASS_CHARS, PASS_ITEMS = 4_000_000, 1 << 14
#: Passes of one stage; the finds of these are written before the next ones.
STAGE_PASSES = 4
#: Bytes that the look-up of windows in the tables takes at once.
LOOKED_UP = 1 << 24


class Part(NamedTuple):
    """An item, or a piece of LARGEST shingles of a long one."""

    item: int
    size: int
    shingles: np.ndarray
    print: int


class Index:
    """Items by the size of their windows. A size's tables are made by the workers, when first needed, and kept."""

    def __init__(self, ids: list, words: int, known: np.ndarray, by_size: dict[int, list[Part]], short: dict[int, tuple[np.ndarray, np.ndarray]], radius: int, blocks: int):
        self.ids, self.words, self.known, self.short, self.radius, self.blocks = ids, words, known, short, radius, blocks
        self.by_size = {n: (found, np.array([p.print for p in found], np.uint64)) for n, found in sorted(by_size.items())}
        self.tables: dict[int, list[np.ndarray]] = {}

    def of(self, size: int) -> tuple[list[Part], np.ndarray, list[np.ndarray]]:
        parts, prints = self.by_size[size]
        if size not in self.tables:
            self.tables[size] = multi_index(prints, self.radius, self.blocks)
        return parts, prints, self.tables[size]


def _near(value: int, bits: int, radius: int):
    yield value
    for r in range(1, radius + 1):
        for flips in combinations(range(bits), r):
            yield value ^ sum(1 << f for f in flips)


def _cut(blocks: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def multi_index(prints: np.ndarray, radius: int, blocks: int) -> list[np.ndarray]:
    """For each block a table (a row for each value) of bit sets: which fingerprints have a value within radius // blocks of it."""
    out = []
    for first, bits in _cut(blocks):
        masks = np.array(sorted(_near(0, bits, radius // blocks)), np.int64)
        table = np.zeros((1 << bits, (len(prints) + 7) // 8), np.uint8)
        for i, fp in enumerate(prints):
            table[masks ^ ((int(fp) >> first) & ((1 << bits) - 1)), i // 8] |= np.uint8(1 << (i % 8))
        out.append(table)
    return out


def candidates(windows: np.ndarray, prints: np.ndarray, tables: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of all pairs within the radius."""
    out = []
    step = max(1, LOOKED_UP // max(1, len(prints)))
    for start in range(0, len(windows), step):
        part = windows[start : start + step]
        hits = np.zeros((len(part), tables[0].shape[1]), np.uint8)
        for (first, bits), table in zip(_cut(len(tables)), tables, strict=True):
            hits |= table[((part >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
        some = np.flatnonzero(hits.any(axis=1))
        w, i = np.nonzero(np.unpackbits(hits[some], axis=1, bitorder="little")[:, : len(prints)])
        close = np.bitwise_count(part[some[w]] ^ prints[i]) <= radius
        out.append((start + some[w[close]], i[close]))
    w, i = zip(*out, strict=True) if out else ((np.zeros(0, np.int64),),) * 2
    return np.concatenate(w), np.concatenate(i)


def build_index(ids: list, texts: list[str | None], words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> Index:
    """Items without words can't be found and are left out."""
    tokens_, token_bounds = tokens.hashed(texts)
    counts = np.diff(token_bounds)
    h, bounds = tokens.shingled(tokens_, token_bounds, words)
    parts: dict[int, list[Part]] = {}
    short: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        n = b - a
        if 0 < counts[i] < words:
            short.setdefault(int(counts[i]), []).append((int(h[a]), i))
            continue
        for at in [0] if n <= LARGEST else [*range(0, n - LARGEST, LARGEST), n - LARGEST]:
            own = h[a + at : a + min(n, at + LARGEST)]
            if len(own):
                parts.setdefault(len(own), []).append(Part(i, len(own), np.sort(own), tokens.simhash(own)))
    looked = {n: (np.array([x for x, _ in sorted(found)], np.uint64), np.array([i for _, i in sorted(found)])) for n, found in short.items()}
    known = np.unique(np.concatenate([h[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(counts >= words)])) if (counts >= words).any() else h[:0]
    return Index(list(ids), words, known, parts, looked, radius, blocks)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets: the sum of smaller counts over that of larger ones."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / max(1, len(a) + len(b) - common)


def matches(index: Index, texts: list[str | None], similarity: float, radius: int) -> list[dict[int, float]]:
    """For each text, the items found in it with their largest similarity."""
    out: list[dict[int, float]] = [{} for _ in texts]
    h, bounds = tokens.hashed(texts)
    for n, (known, items) in index.short.items():
        runs, place = tokens.runs(h, bounds, n)
        lo, hi = (np.searchsorted(known, runs, side) for side in ("left", "right"))
        hit = np.flatnonzero(hi > lo)
        for d, x, y in set(zip((np.searchsorted(bounds, place[hit], side="right") - 1).tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True)):
            out[d].update(dict.fromkeys(items[x:y].tolist(), 1.0))
    own, own_bounds = tokens.shingled(h, bounds, index.words)
    if not len(own) or not len(index.known):
        return out
    at = np.searchsorted(index.known, own)
    seeds = np.flatnonzero(index.known[np.minimum(at, len(index.known) - 1)] == own)
    if not len(seeds):
        return out
    doc = np.searchsorted(own_bounds, seeds, side="right") - 1
    longest = max(index.by_size)
    # stretches of a document in which windows can hold a seed, joined where they overlap
    lo = np.maximum(seeds - longest + 1, own_bounds[doc])
    hi = np.minimum(seeds + longest, own_bounds[doc + 1])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] >= np.maximum.accumulate(hi)[:-1])))
    last = np.append(first[1:], len(seeds)) - 1
    lengths = hi[last] - lo[first]
    place = np.concatenate([np.arange(a, b) for a, b in zip(lo[first], hi[last], strict=True)])
    stretches, of = own[place], np.repeat(np.arange(len(first)), lengths)
    seeded = np.concatenate(([0], np.cumsum(np.isin(place, seeds))))
    begins = np.concatenate(([0], np.cumsum(lengths)))

    def verify(starts, width: int, parts: list[Part], chosen) -> None:
        for start, k in zip(starts.tolist(), chosen.tolist(), strict=True):
            s = weighted_similarity(stretches[start : start + width], parts[k].shingles)
            here = out[doc[first[of[start]]]]
            if s >= similarity and s > here.get(parts[k].item, 0.0):
                here[parts[k].item] = s

    whole = np.flatnonzero(lengths == np.diff(own_bounds)[doc[first]])
    for size in index.by_size:
        parts, prints, tables = index.of(size)
        windows = tokens.simhash_windows(stretches, size)
        if len(windows):
            inside = np.flatnonzero((of[size - 1 :] == of[: len(windows)]) & (seeded[size:] > seeded[:-size]))
            w, i = candidates(windows[inside], prints, tables, radius)
            verify(inside[w], size, parts, i)
        # a document that is shorter than the item, but not too short to be like it, is one window
        for k in whole[(lengths[whole] < size) & (lengths[whole] >= similarity * size)]:
            w, i = candidates(np.array([tokens.simhash(stretches[begins[k] : begins[k + 1]])], np.uint64), prints, tables, radius)
            verify(begins[k] + w, int(lengths[k]), parts, i)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row per row of docs: the id, the kept columns, ``items`` (sorted distinct ids of the items found),
    ``n_items`` and ``similarity`` (the largest, 0 without a find).

    Null and empty texts, and an empty benchmark, give no finds; items that are null or without words are never found; items
    with the same text, and several items of an id, are all looked for. An item of one to four words is found wherever these
    words follow one another. Repeated rows are each scanned. Columns of ``keep`` may have any name other than those that the
    result has itself; no other columns are read. Rows are scanned where they are read, without a shuffle; the benchmark is
    broadcast in passes of up to about ``pass_chars`` characters and PASS_ITEMS items, and the finds are written after every
    STAGE_PASSES of them, so that neither the plan nor a worker grows with the benchmark.
    """
    spark = docs.sparkSession
    rest = [id_col, *(c for c in keep if c != id_col)]
    if clash := {"items", "n_items", "similarity"} & set(rest):
        raise ValueError(f"columns {sorted(clash)} are those of the result")
    items = benchmark.select(benchmark[item_col].alias("id"), benchmark[item_text_col].alias("text")).where("id is not null and text is not null")
    chars, count = items.agg(F.sum(F.length("text")), F.count("*")).first()
    passes = max(1, -(-(chars or 0) // pass_chars), -(-count // PASS_ITEMS))
    slot = F.pmod(F.xxhash64("id", "text"), F.lit(passes))
    item_type = benchmark.schema[item_col].dataType
    # names of our own while passing, so that none can clash
    names = [f"__c{i}" for i in range(len(rest))]
    out = docs.select(*(docs[c].alias(n) for c, n in zip(rest, names, strict=True)), docs[text_col].alias("__text"), F.array().cast(T.ArrayType(item_type)).alias("items"), F.lit(0.0).alias("similarity"))
    for k in range(passes):
        some = sorted(items.where(slot == k).collect(), key=lambda r: (str(r["id"]), r["text"]))
        index = spark.sparkContext.broadcast(build_index([r["id"] for r in some], [r["text"] for r in some], words, radius))
        out = out.mapInArrow(_pass(index, names, similarity, radius, out.schema), out.schema)
        if k % STAGE_PASSES == STAGE_PASSES - 1 and k + 1 < passes:
            out = saved(out, "passes")
    found = F.array_sort(F.array_distinct("items"))
    return out.select(*(F.col(n).alias(c) for c, n in zip(rest, names, strict=True)), found.alias("items"), F.size(found).cast("long").alias("n_items"), "similarity")


def _pass(index, rest: list[str], similarity: float, radius: int, schema: T.StructType):
    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 2 << 20):
                rows = slice(part.start, part.stop)
                found = matches(index.value, texts[rows].to_pylist(), similarity, radius)
                before, best = batch.column("items")[rows].to_pylist(), batch.column("similarity")[rows].to_pylist()
                items = [(b or []) + [index.value.ids[i] for i in sorted(f)] for b, f in zip(before, found, strict=True)]
                best = [max([b, *f.values()]) for b, f in zip(best, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[rows] for i in range(len(rest) + 1)), pa.array(items, batch.schema.field("items").type), pa.array(best, pa.float64())], names=schema.names)

    return run
