"""Best-fit packing of documents into sequences of tokens, with matching of large items (operator 12).

A document's ids and an end mark are one item; documents longer than a sequence are cut into pieces, of which the first may be
shorter. There are no more sizes than tokens in a sequence, so the packing is planned on the number of items of each size:

* items over a third of the capacity go at most two to a sequence; pairs are made greedily, each time of the largest item that is
  left and the largest that fits beside it, which makes as many pairs as any way can;
* smaller items, largest first, go where they leave the smallest gap.

The plan is a short list of runs: so many items of a size, counted in order, go to so many sequences at an offset. Tasks look up
their items in it by size and number, so no task and no driver ever holds the items themselves.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cairn.llm import bpe
from cairn.llm.shared import saved, slices

# Tokens of a sequence, and the id behind each document.
CAPACITY, END = 1024, 2


class Codec(bpe.Codec):
    """Ids by a tokenizer's file, for byte-level BPE whose text is split by ``pattern``: what the file gives for a whole text is
    what it gives for each pre-token, so that whole texts need no more memory than a chunk, and frequent pre-tokens are remembered.
    Strings of its special tokens, such as the mark between texts, become their ids, as they do in the file's own encoding."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), bpe.CHUNK, bpe.OVERLAP
        self.narrow, self.wide = bpe.narrowed(pattern), regex.compile(f"[^\\x00-\\u{bpe.NARROW - 1:04x}]")
        self.known: dict[str, bytes] = {}
        marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = {s: np.array([i], "<u4").tobytes() for s, i in marks.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None

    def piece(self, piece: str) -> bytes:
        ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= bpe.SHORT and len(self.known) < bpe.REMEMBERED:
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.parts or not any(m in text for m in self.marks):
            return super().encode(text)
        return b"".join(self.marks.get(part) or super(Codec, self).encode(part) for part in self.parts.split(text) if part)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Run(NamedTuple):
    """Items of ``size`` with numbers from ``since`` on, ``items`` of them, go ``each`` to a sequence, from sequence ``first`` on,
    the first of each sequence at ``offset``."""

    size: int
    since: int
    items: int
    first: int
    each: int
    offset: int


def planned(sizes: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for so many items of each size (1 to the capacity), and the number of sequences.

    Sequences that are filled alike stand in one group. A size adds three groups at most, and each time that a group takes items its gap
    is more than halved, so there are under 40 * capacity * log2(capacity) runs, whatever the number of items.
    """
    left = {s: n for s, n in sizes.items() if n}
    runs, taken, total = [], dict.fromkeys(left, 0), 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, sequences) by what is free in them

    def put(size: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append(Run(size, taken[size], n, first, each, offset))
        taken[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        alone = left[size] == 1
        fits = [s for s in large if s <= capacity - size and left[s] and not (alone and s == size)]
        partner = fits[-1] if fits else None
        if partner is None:
            n = left[size]
            put(size, n, total, 1, 0)
            gaps[capacity - size].append((total, n))
        elif partner == size:
            n = left[size] // 2
            put(size, 2 * n, total, 2, 0)
            gaps[capacity - 2 * size].append((total, n))
        else:
            n = min(left[size], left[partner])
            put(size, n, total, 1, 0)
            put(partner, n, total, 1, size)
            gaps[capacity - size - partner].append((total, n))
        total += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        for gap in range(size, capacity + 1):
            while gaps[gap] and left[size]:
                first, count = gaps[gap].pop()
                each = gap // size
                full = min(count, left[size] // each)
                if full:
                    put(size, full * each, first, each, capacity - gap)
                    gaps[gap - each * size].append((first, full))
                rest = min(left[size], each) if full < count else 0
                if rest:
                    put(size, rest, first + full, rest, capacity - gap)
                    gaps[gap - rest * size].append((first + full, 1))
                untouched = count - full - bool(rest)
                if untouched:
                    gaps[gap].append((first + full + bool(rest), untouched))
            if not left[size]:
                break
        each = capacity // size
        full, rest = divmod(left[size], each)
        for count, n in ((full, each), (1, rest)):
            if count and n:
                put(size, count * n, total, n, 0)
                gaps[capacity - n * size].append((total, count))
                total += count
    return runs, total


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The id, piece (from 0), start (ids of the document before it), length, ids (array<int>; with ``digest`` ids_crc32 in their place), and
    part, place: the number of the piece among those of its length that the same task read. No shuffle."""
    kind = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length")]
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *longs, kind, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    mark = np.array([end], "<u4").tobytes()

    def run(batches):
        c, part, seen = codec(path, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for some in slices((len(x.as_buffer()) if x.is_valid else 0 for x in texts), 1 << 20):
                of, rows = [], []
                for at in range(some.start, some.stop):
                    ids = c.encode(texts[at].as_py()) + mark
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for number, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        own = ids[4 * a : 4 * b]
                        rows.append((number, a, b - a, zlib.crc32(own) if digest else np.frombuffer(own, "<i4"), part, int(seen[b - a])))
                        of.append(at)
                        seen[b - a] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), *(pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids (or ids_crc32), sequence_id and offset.

    Offsets in a sequence begin at 0 and leave no gap. A null text is an empty one: its only id is the end mark, as every document
    has it. Repeated rows are packed each, their pieces told apart by sequence and offset only; an empty table gives an empty one; other columns
    are not read.
    """
    items = saved(pieces(docs, path, pattern, capacity, end, id_col, text_col, digest), "pieces")
    by_task = saved(items.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    runs, _ = planned({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # a run for each row, by size and first number; their number is bounded by the capacity
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    plan = docs.sparkSession.sparkContext.broadcast(table)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    counted = items.join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("place"))
    value = "ids_crc32" if digest else "ids"
    kept = [id_col, "piece", "start", "length", value]
    schema = T.StructType([*(items.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        runs = plan.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            size, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            own = runs[np.searchsorted(keys, (size << 48) + number, "right") - 1]
            nth = number - own[:, 1]
            columns = [pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=schema.names)

    return counted.select(*kept, "number").mapInArrow(place, schema)


def sequences(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences that ``packed`` (with ids) makes: sequence_id, ids (array<int>) and docs, an array of (id, piece, offset, length)
    that says which of them are whose; a sequence has no more pieces than tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids")))
    rows = found.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("docs"))
