"""Importance resampling towards a target distribution, with overlap chunking of long texts (operator 13).

Features are runs of 1 to n consecutive words, hashed to buckets. A bucket's gain says how much more of the target's features
than of the corpus's fall into it; a document's weight is the mean gain of its features, and documents with the highest sums
of weight and Gumbel noise are drawn.

A long text is cut into chunks at word boundaries. A chunk carries the n - 1 words that follow it, and owns the features that
begin in it, so each feature of the text is counted by exactly one chunk. Chunks are rows, dealt evenly to tasks; their counts
and gains are summed by document. Short texts are one chunk and are read where they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import saved
from cairn.operators.running import running

# Hash buckets, words of a feature at most, words that a drawn document has at least, percent drawn, and the seed.
BUCKETS, WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of a chunk, and of a text that is read as a whole.
CHUNK = 1 << 16
#: Features whose bucket a worker remembers.
REMEMBERED = 1 << 20

#: ASCII letters in lower case, digits and the bytes of all other characters stand for themselves, all else for a space.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """The bucket of each feature (bytes), remembered for some."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def owned(words: list[bytes], own: int, n: int) -> Iterator[list[bytes]]:
    """The features of 1, 2 .. n words that begin at the first ``own`` words."""
    yield words[:own]
    for size in range(2, n + 1):
        yield [b" ".join(words[i : i + size]) for i in range(min(own, len(words) - size + 1))]


def chunks(signs: bytes, chunk: int, n: int) -> Iterator[tuple[bytes, int]]:
    """(words of a chunk and the n - 1 behind it, how many are its own); signs: a text whose words are parted by spaces."""
    at = 0
    while at < len(signs):
        end = min(at + chunk, len(signs))
        if end < len(signs):
            cut = signs.rfind(b" ", at, end)
            end = cut if cut > at else signs.find(b" ", end)
            end = len(signs) if end < 0 else end
        carried, behind = end, n - 1
        while behind and carried < len(signs):  # up to the end of n - 1 further words
            while carried < len(signs) and signs[carried] == 32:
                carried += 1
            stop = signs.find(b" ", carried)
            carried, behind = len(signs) if stop < 0 else stop, behind - 1
        yield signs[at:carried], len(signs[at:end].split())
        at = end


def _parts(docs: DataFrame, id_col: str, text_col: str, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """id, words, own of short texts (own is null: all of them), and row, id, words, own of the chunks of long ones."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.where(size <= chunk).select("id", F.col("text").alias("words"), F.lit(None).cast("long").alias("own"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("k", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("own", T.LongType())])

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, signs = batch.slice(i, 1), batch.column("text")[i].as_py().translate(_SIGNS)
                for k, (words, own) in enumerate(chunks(signs, chunk, n)):
                    yield pa.RecordBatch.from_arrays([one.column("row"), one.column("id"), pa.array([k]), pa.array([words], pa.binary()), pa.array([own])], names=schema.names)

    long = rows.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(split, schema)
    return short, saved(long.repartition("row", "k"), "chunks")


def _counted(parts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: a row for each bucket that a partition met."""

    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, own in zip(batch.column("words"), batch.column("own"), strict=True):
                words = (raw.as_py() or b"").translate(_SIGNS).split()
                for features in owned(words, len(words) if not own.is_valid else own.as_py(), n):
                    total += np.bincount(np.fromiter(map(known.__getitem__, features), np.int64, len(features)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return parts.select("words", "own").mapInArrow(run, "bucket long, n long")


def bucket_counts(docs: DataFrame, n: int = WORDS, buckets: int = BUCKETS, text_col: str = "text", chunk: int = CHUNK, parts: tuple[DataFrame, DataFrame] | None = None) -> np.ndarray:
    """How many features of all texts fall into each bucket; one number for each bucket reaches the driver."""
    short, long = parts or _parts(docs.select(docs[text_col], F.lit(0).alias("__id")), "__id", text_col, n, chunk)
    found = _counted(short, n, buckets).unionByName(_counted(long, n, buckets)).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, count in found.collect():
        out[bucket] = count
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln of the target's share over the corpus's), each count raised by one."""
    all_s, all_t, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(parts: DataFrame, of: np.ndarray, n: int, keys: list[str]) -> DataFrame:
    """keys, n_words, n_features and gain (a sum) of each part."""
    schema = T.StructType([*(parts.schema[c] for c in keys), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "gain"))])

    def run(batches):
        known = Buckets(len(of))
        for batch in batches:
            rows = []
            for raw, own in zip(batch.column("words"), batch.column("own"), strict=True):
                words = (raw.as_py() or b"").translate(_SIGNS).split()
                n_words = len(words) if not own.is_valid else own.as_py()
                features, gain = 0, 0
                for some in owned(words, n_words, n):
                    features += len(some)
                    gain += int(of[np.fromiter(map(known.__getitem__, some), np.int64, len(some))].sum())
                rows.append((n_words, features, gain))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(list(c), pa.int64()) for c in columns)], names=schema.names)

    return parts.select(*keys, "words", "own").mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: the id, n_features, weight, score and rank (all long but the id): ``rank`` counts the drawn ones
    from 1, by score (highest first), then id; it is null for the others.

    Of the documents with ``least_words`` words or more, floor(percent * their number / 100) are drawn. Words are runs of ASCII
    letters (A-Z lower-cased), ASCII digits and any other characters beyond ASCII. A null or empty text has no features and
    weight 0. The noise depends on seed and id alone: repeated rows have equal scores, each is a row of its own and takes a
    place of its own. A null id counts as an empty one for the noise and comes last among ties. Ties beyond the id: by fewer
    features, then lower weight. An empty target has gains by the corpus's counts alone; an empty table gives an empty one. Other
    columns are not read.

    To the driver come two numbers for each bucket, and one for each score that occurs, of which there are no more than the
    range of gains and of the noise holds (under 100,000 with 10,000 buckets).
    """
    parts = _parts(docs, id_col, text_col, n, chunk)
    of = gains(bucket_counts(docs, n, buckets, parts=parts), bucket_counts(target, n, buckets, target_col, chunk))
    whole = _weighed(parts[0], of, n, ["id"])
    summed = _weighed(parts[1], of, n, ["row", "id"]).groupBy("row").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain"))).drop("row")
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = whole.unionByName(summed).withColumn("weight", weight).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = saved(scored.select("id", "n_words", "n_features", "weight", "score"), "scores")

    fit = F.col("n_words") >= least_words
    at = sorted(scored.where(fit).groupBy("score").count().collect(), reverse=True)
    k = percent * sum(c for _, c in at) // 100
    ahead, least = 0, None
    for score, count in at:
        if ahead < k:
            ahead, least = ahead + count, score
    reaches = fit & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    # a number of its own for each row, so that no crowd of equal rows shares a task
    close = scored.where(reaches).withColumn("own", F.monotonically_increasing_id())
    ranked = running(close, [], [-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("n_features"), F.col("weight"), F.col("own")], {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    out = ranked.drop("own").unionByName(scored.where(~reaches).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


# CRC-32 of words in SQL: by the table of its 256 remainders, a byte at a time
CRC32_SQL = """
crc_steps AS (SELECT CAST(i AS UBIGINT) AS b, CAST(i AS UBIGINT) AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, n + 1 FROM crc_steps WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY b) AS remainders FROM crc_steps WHERE n = 8),
crc_words AS (SELECT word, hex(encode(word)) AS x FROM ({words})),
crc_fold AS (SELECT word, x, 0 AS pos, 4294967295::UBIGINT AS c FROM crc_words
  UNION ALL SELECT word, x, pos + 1, xor(c >> 8, remainders[CAST(xor(c, CAST(concat('0x', substr(x, 2 * pos + 1, 2)) AS UBIGINT)) & 255 AS BIGINT) + 1])
    FROM crc_fold, crc_table WHERE 2 * pos < length(x)),
crcs AS (SELECT word, CAST(xor(c, 4294967295::UBIGINT) AS BIGINT) AS crc FROM crc_fold WHERE 2 * pos = length(x))
"""

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RESAMPLED_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS words FROM documents),
goal AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
each AS (SELECT r, unnest(words) AS word FROM docs),
of_doc AS (SELECT r, word, count(*) AS n FROM each GROUP BY r, word),
{CRC32_SQL.format(words="SELECT word FROM each UNION SELECT word FROM goal")},
buckets AS (SELECT word, crc % 10000 AS bucket FROM crcs),
s AS (SELECT bucket, sum(n) AS s FROM of_doc JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gains AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket), sums),
weighed AS (SELECT r, sum(n) AS n, floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS weight FROM of_doc JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * fit // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
