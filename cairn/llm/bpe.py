"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks (operator 8).

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own. Two neighbours are stitched at the first
pre-token boundary that both have inside their overlap, at which what follows no longer depends on where a chunk began;
where there is none, the overlap is widened. Each piece is then encoded by the ranks; decoding joins the pieces' bytes.

The chunks of long texts are rows of their own: tasks pre-tokenise them in parallel, neighbours meet in a join of their
boundaries, and tasks encode what lies between two seams. Short texts are encoded where they are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import saved, slices

#: Characters of a chunk, and of what two neighbours share.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Texts of more characters than this are cut into chunks that are dealt to tasks.
LONG = 1 << 20
#: Characters behind a boundary that the pattern's look-ahead may read; boundaries nearer to a chunk's end aren't trusted.
LOOKAHEAD = 2
#: A worker remembers the ids of so many pieces of up to so many bytes.
SHORT, REMEMBERED = 32, 400_000
#: Below this character the classes of a pattern can be spelled out, which a simpler matcher runs faster.
NARROW = 0x250


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def narrowed(pattern: str) -> re.Pattern | None:
    """The same pattern with its classes spelled out, for texts of characters below NARROW only; None if it has other classes."""

    def spelled(kind: str) -> str:
        return "".join(f"\\u{i:04x}" for i in range(NARROW) if regex.match(kind, chr(i)))

    space, letter, number = spelled(r"\s"), spelled(r"\p{L}"), spelled(r"\p{N}")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    out = out.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    return None if re.search(r"\\[^u]", out) else re.compile(out)


def _boundaries(pattern, text: str, start: int, end: int) -> list[int]:
    """Ends of the pre-tokens of text[start:end], taken as if nothing stood outside."""
    return [start + m.end() for m in pattern.finditer(text[start:end])]


def pretokenised(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
    """The pre-tokens of a whole text, from chunks that are pre-tokenised independently.

    A boundary b of the earlier chunk is final if it lies LOOKAHEAD before that chunk's end, or the chunk ends the text.
    The later chunk resynchronises at the first boundary in the overlap that both have: from there on, both read alike.
    """
    if len(text) <= chunk:
        yield from pattern.findall(text)
        return
    spans = [(at, min(at + chunk + overlap, len(text))) for at in range(0, len(text), chunk)]
    cuts = [_boundaries(pattern, text, a, b) for a, b in spans]
    done = 0  # what is before is given out
    k = 0
    current, stop = cuts[0], spans[0][1]
    while True:
        if stop == len(text) or k + 1 == len(spans):
            for end in current:
                if end > done:
                    yield text[done:end]
                    done = end
            return
        start = spans[k + 1][0]
        final = {x for x in current if start < x <= stop - LOOKAHEAD and x > done}
        meet = next((x for x in cuts[k + 1] if x in final), None)
        if meet is None:  # no common boundary: read the later chunk together with the earlier one
            stop = spans[k + 1][1]
            current = _boundaries(pattern, text, done, stop)
            k += 1
            continue
        for end in current:
            if done < end <= meet:
                yield text[done:end]
                done = end
        k += 1
        current, stop = [x for x in cuts[k] if x > meet], spans[k][1]


class Codec:
    """Encodes and decodes; built once in each worker. Ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        ranks = read_ranks(ranks_path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        self.narrow, self.wide = narrowed(pattern), re.compile(f"[^\\x00-\\u{NARROW - 1:04x}]")
        # one piece at a time: the pattern of the library's encoding takes whatever it is given as one pre-token
        self.core = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = array("I", self.core.encode_ordinary(piece)).tobytes()
        if len(piece) <= SHORT and len(self.known) < REMEMBERED:
            self.known[piece] = ids
        return ids

    def pattern_for(self, text: str):
        return self.narrow if self.narrow and not self.wide.search(text) else self.pattern

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        return self.pieces(pretokenised(self.pattern_for(text), text, self.chunk, self.overlap))

    def pieces(self, parts) -> bytes:
        known, piece = self.known, self.piece
        return b"".join([known.get(p) or piece(p) for p in parts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, chunk: int, overlap: int) -> Codec:
    return Codec(ranks_path, pattern, chunk, overlap)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG) -> DataFrame:
    """One row per row of docs: the id, ``n_tokens``, ``ids`` (array<int>) and ``decoded`` (binary, from the ids).

    digest: ``ids_sha256`` and ``decoded_sha256`` in place of the last two. A null text encodes as an empty one, an empty
    one as no ids; repeated rows are each encoded; an empty table gives an empty one; other columns are not read. A text of
    any length is read whole, a chunk at a time. Texts of up to ``long`` characters are encoded where they are read; only the
    chunks of longer ones are shuffled, and only one text's ids are put together in a task, as they make one row.
    """
    id_type = docs.schema[id_col].dataType
    kinds = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), *(T.StructField(*k) for k in kinds)])
    arrow = [pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.binary()]
    chunk, overlap = max(2, chunk), max(1, min(overlap, chunk - 1))

    def told(c: Codec, ids: bytes) -> tuple:
        raw = c.decode(ids)
        return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (len(ids) // 4, np.frombuffer(ids, "<i4"), raw)

    def run(batches):
        c = codec(ranks_path, pattern, chunk, overlap)
        for batch in batches:
            texts = batch.column("text")
            for part in slices((len(x.as_buffer()) if x.is_valid else 0 for x in texts), 4 << 20):
                columns = zip(*(told(c, c.encode(text)) for text in texts[part.start : part.stop].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.start : part.stop], *(pa.array(v, t) for v, t in zip(columns, arrow, strict=True))], names=schema.names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    short = rows.where(F.col("text").isNull() | (F.length("text") <= long)).mapInArrow(run, schema)
    rest = saved(rows.where(F.length("text") > long).select(F.monotonically_increasing_id().alias("row"), "id", "text"), "long")
    if not rest.take(1):
        return short
    cut = saved(_cut(rest, ranks_path, pattern, chunk, overlap), "cut")
    # a seam is the first boundary that the end of one chunk and the beginning of the next have in common
    before = cut.where("tail is not null").select("row", (F.col("k") + 1).alias("k"), "tail")
    seams = before.join(cut.select("row", "k", "head"), ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("tail", "head")).alias("seam"))
    seams = saved(seams, "seams")
    open_ = seams.where("seam is null").select("row").distinct()
    whole = rest.join(open_, "row", "left_semi").select("id", "text").mapInArrow(run, schema)
    begins, ends = seams.select("row", "k", F.col("seam").alias("begin")), seams.select("row", (F.col("k") - 1).alias("k"), F.col("seam").alias("end"))
    parts = cut.join(open_, "row", "left_anti").join(begins, ["row", "k"], "left").join(ends, ["row", "k"], "left").select("row", "id", "k", "start", "text", "cuts", "begin", "end")

    def encode(batches):
        c = codec(ranks_path, pattern, chunk, overlap)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cuts, start = np.frombuffer(r["cuts"], np.int64), r["start"]
                kept = cuts[(cuts > (-1 if r["begin"] is None else r["begin"])) & (cuts <= (cuts[-1] if r["end"] is None else r["end"]))].tolist()
                at = [start if r["begin"] is None else r["begin"], *kept]
                out.append(c.pieces(r["text"][a - start : b - start] for a, b in zip(at, at[1:], strict=False)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), pa.array(out, pa.binary())], names=["row", "id", "k", "ids"])

    coded = parts.mapInArrow(encode, T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("k", T.LongType()), T.StructField("ids", T.BinaryType())]))

    def together(table: pa.Table) -> pa.Table:
        c, table = codec(ranks_path, pattern, chunk, overlap), table.sort_by("k")
        row = told(c, b"".join(table.column("ids").to_pylist()))
        return pa.Table.from_arrays([table.column("id").slice(0, 1), *(pa.array([v], t) for v, t in zip(row, arrow, strict=True))], names=schema.names)

    return short.unionByName(whole).unionByName(coded.groupBy("row").applyInArrow(together, schema))


def _cut(rows: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """row, id, k, start, text, cuts: the chunks of texts, dealt evenly and pre-tokenised each on its own; cuts are the ends of
    the pre-tokens (int64, places in the whole text). head and tail: the cuts that lie in the overlap with the chunk before
    (null for the first) and, as far as they are final, with the chunk behind (null for the last)."""
    id_field = rows.schema["id"]
    pieces = T.StructType([T.StructField("row", T.LongType()), id_field, T.StructField("k", T.LongType()), T.StructField("start", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, one = batch.column("text")[i].as_py(), batch.slice(i, 1)
                for k, start in enumerate(range(0, len(text), chunk)):
                    part = [pa.array([v], t) for v, t in ((k, pa.int64()), (start, pa.int64()), (start + chunk >= len(text), pa.bool_()), (text[start : start + chunk + overlap], pa.string()))]
                    yield pa.RecordBatch.from_arrays([one.column("row"), one.column("id"), *part], names=pieces.names)

    ends = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), id_field, T.StructField("k", T.LongType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType()), T.StructField("cuts", T.BinaryType()), T.StructField("head", ends), T.StructField("tail", ends)])

    def pretokenise(batches):
        c = codec(ranks_path, pattern, chunk, overlap)
        for batch in batches:
            cuts, heads, tails = [], [], []
            for r in batch.select(["k", "start", "last", "text"]).to_pylist():
                own = r["start"] + np.array([m.end() for m in c.pattern_for(r["text"]).finditer(r["text"])], np.int64)
                end = r["start"] + len(r["text"])
                cuts.append(own.tobytes())
                heads.append(own[own <= r["start"] + overlap].tolist() if r["k"] else None)
                tails.append(None if r["last"] else own[(own > r["start"] + chunk) & (own <= end - LOOKAHEAD)].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "id", "k", "start", "text")), pa.array(cuts, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(split, pieces).repartition("row", "k").mapInArrow(pretokenise, schema)
