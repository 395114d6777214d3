"""Quality of documents by importance resampling (operator 1).

Two generative models over hashed 1- and 2-grams are counted: one of a target (labelled rows that are good and not toxic),
one of all raw text. An n-gram counts once a document, else one page that repeats a word decides on all words of its bucket;
immediate repetitions are features of their own, by the length of the run, and count each time. The log ratio of an n-gram
says how much more often the target has it than its share of the raw text; of each ratio as much as chance explains (ERRORS
standard errors of the expected count) is taken off, so that the very many rare n-grams of a long text don't add up to a
verdict. A document is scored by counts that leave the document itself out, so labelled and other documents compare.

A document's log weight is the log ratio of the two models for its whole text: the sum over all its n-grams. Standard Gumbel
noise, fixed by the document, is added, and the documents with the k largest keys are kept: a sample without replacement by
importance. k may be given as a share; else it is the number of documents whose weight reaches the cut that separates good
from bad labelled rows best.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import tokens
from cairn.llm.shared import saved, slices

#: Hash buckets of 1- and of 2-grams each (a power of two), n-grams added to both counts of a ratio, and standard errors that
#: are taken off a log ratio.
BUCKETS, SMOOTHING, ERRORS = 1 << 19, 0.5, 11.0
#: Buckets whose ratios travel together.
BLOCK = 1 << 16
#: The last buckets are runs of 2, of 3 and of more equal tokens.
RUNS = 3
#: What a good row that is dropped weighs against a bad row that is kept, when the cut is chosen.
GOOD_WEIGHT = 3.0
#: Labelled rows that the target and the cut are taken from at most, and the temperature of the sampling (1: standard noise).
LABELLED, TEMPERATURE = 20_000, 1.0
#: Keys that the driver sorts to end the search for the k-th largest.
LAST_KEYS = 10_000


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-grams and of the 2-grams that begin at each token (-1 at a text's last; one of the last RUNS buckets
    for equal tokens), and the texts' bounds."""
    h, bounds = tokens.hashed(texts, marks=True)
    one = (h & np.uint64(buckets - 1)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        same = h[:-1] == h[1:]
        same[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(h))] - 1] = False
        # how many equal neighbours in a row end here
        place = np.arange(1, len(same) + 1)
        run = place - np.maximum.accumulate(np.where(same, 0, place))
        hashed = (tokens.mixed(h[:-1] * np.uint64(3) ^ h[1:]) % np.uint64(buckets - RUNS)).astype(np.int64) + buckets
        two[:-1] = np.where(same, 2 * buckets - 1 - RUNS + np.minimum(run, RUNS), hashed)
        two[bounds[1:][np.diff(bounds) > 0] - 1] = -1
    return one, two, bounds


def counted(docs: DataFrame, target, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: counts over all rows and over those for which the column ``target`` is true. Each partition gives
    out one row for each bucket it has met."""

    def run(batches):
        raw, good = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for batch in batches:
            texts, flags = batch.column("text"), batch.column("target").to_numpy(zero_copy_only=False)
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 4 << 20):
                one, two, bounds = ngrams(texts[part.start : part.stop].to_pylist(), buckets)
                own = flags[part]
                doc = np.repeat(np.arange(len(own)), np.diff(bounds))
                for grams in (one, two):
                    has = (grams >= 0) & (grams < 2 * buckets - RUNS)
                    once = np.unique(doc[has] * (2 * buckets) + grams[has])
                    np.add.at(raw, once % (2 * buckets), 1)
                    np.add.at(good, once[own[once // (2 * buckets)]] % (2 * buckets), 1)
                again = two >= 2 * buckets - RUNS
                raw += np.bincount(two[again], minlength=2 * buckets)
                good += np.bincount(two[again & own[doc]], minlength=2 * buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "target"])

    rows = docs.select(docs[text_col].alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    return rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, errors: float = ERRORS) -> np.ndarray:
    """Two rows of log ratios: for documents outside the target and for those in it, each without the document's own count. All
    is zero without a target. They are made where the counts are, in blocks of BLOCK buckets; two small numbers a bucket reach
    the driver, whatever the size of the corpus."""
    counts = saved(counts, "counts")
    runs = F.col("bucket") >= 2 * buckets - RUNS
    raw_sum, good_sum, any_good = counts.agg(F.sum(F.when(~runs, F.col("raw"))), F.sum(F.when(~runs, F.col("target"))), F.sum("target")).first()
    out = np.zeros((2, 2 * buckets), np.float16)
    if not any_good:
        return out
    share = (good_sum or 0) / max(1.0, raw_sum or 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["bucket"].to_numpy()
        raw, good, leave = pdf["raw"].to_numpy(float), pdf["target"].to_numpy(float), (at < 2 * buckets - RUNS).astype(float)
        block = np.zeros((2, BLOCK), np.float16)
        for own in (0, 1):
            expected, seen = np.maximum(raw - leave, 0) * share, np.maximum(good - own * leave, 0)
            ratio = np.log((seen + smoothing) / (expected + smoothing))
            block[own, at % BLOCK] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - errors / np.sqrt(expected + 2))
        return pd.DataFrame({"block": [int(at[0]) // BLOCK], "ratios": [block.tobytes()]})

    for row in counts.groupBy(F.floor(F.col("bucket") / BLOCK)).applyInPandas(run, "block long, ratios binary").toLocalIterator():
        width = min(BLOCK, 2 * buckets)
        out[:, row["block"] * BLOCK : row["block"] * BLOCK + width] = np.frombuffer(row["ratios"], np.float16).reshape(2, BLOCK)[:, :width]
    return out


def weights(texts: list[str | None], in_target: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Log weights: of each text the sum of the log ratios of all its n-grams; -inf for texts without tokens."""
    one, two, bounds = ngrams(texts, ratios.shape[1] // 2)
    own = np.repeat(in_target.astype(np.int64), np.diff(bounds))
    each = ratios[own, one].astype(np.float64) + np.where(two >= 0, ratios[own, two], 0.0)
    total = np.concatenate(([0.0], np.cumsum(each)))
    out = np.where(np.diff(bounds) > 0, total[bounds[1:]] - total[bounds[:-1]], -np.inf)
    return np.round(out, 6)  # sums in another order of rows differ by less


def weighted(docs: DataFrame, ratios: np.ndarray, keep: list[str], text_col: str = "text", target: str = "__good") -> DataFrame:
    """The kept columns and log_weight of each row; the column ``target`` says (true) which rows the target counts. No shuffle."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("log_weight", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            texts, flags = batch.column(len(keep)), batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 2 << 20):
                rows = slice(part.start, part.stop)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[rows] for i in range(len(keep))), pa.array(weights(texts[rows].to_pylist(), flags[rows], shared.value))], names=schema.names)

    return docs.select(*(docs[c] for c in keep), docs[text_col].alias("__text"), F.coalesce(docs[target], F.lit(False)).alias("__flag")).mapInArrow(run, schema)


def best_cut(weight: np.ndarray, good: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The cut, midway between two rows, that maximises the share of bad rows under it and, times good_weight, that of good rows
    at or over it; the lowest of equals; -inf without both kinds."""
    finite = np.isfinite(weight)
    weight, good = weight[finite], good[finite]
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    kept = 1 - np.concatenate(([0], np.cumsum(g))) / g.sum()
    dropped = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    rate = good_weight * kept + dropped
    rate[1:-1][w[1:] == w[:-1]] = -1  # no cut among equals
    at = int(np.argmax(rate))
    if at == 0:
        return -np.inf
    return float(w[at - 1] + w[at]) / 2 if at < len(w) else float(np.nextafter(w[-1], np.inf))


def kth_largest(rows: DataFrame, column: str, k: int, last: int = LAST_KEYS, bins: int = 512) -> float:
    """The k-th largest value of a column of finite doubles, from histograms that narrow the range until few rows are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = rows.where(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high
        n = inside.count()
        if n <= last:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1]
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(slot.alias("slot")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for s in sorted(found, reverse=True):
            if above + found[s][0] >= k:
                low, high = found[s][1:]
                break
            above += found[s][0]


def _noise(id_col: Column) -> Column:
    """Gumbel noise from a uniform number that the id fixes."""
    uniform = (F.xxhash64(F.lit("gumbel"), F.coalesce(id_col.cast("string"), F.lit("\0"))) / F.lit(float(1 << 64)) + 0.5) * (1 - 2e-9) + 1e-9
    return -F.log(-F.log(uniform))


class Sampler(NamedTuple):
    """What decides on a document: the log ratios, the labelled rows (with which are in the target), the temperature and the
    least key of those that stay."""

    ratios: np.ndarray
    sample: DataFrame
    temperature: float
    least: float


def _flagged(docs: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """docs with __good: true or false for labelled rows. sample has a bounded number of rows."""
    return docs.join(F.broadcast(sample), docs[id_col] == F.col("__id"), "left").drop("__id")


def _decided(weighed: DataFrame, temperature: float, least: float, id_col: str) -> DataFrame:
    finite = F.col("log_weight") > F.lit(float("-inf"))
    keyed = weighed.withColumn("gumbel_key", F.when(finite, F.col("log_weight") / temperature + _noise(F.col(id_col))))
    return keyed.withColumn("log_weight", F.when(finite, F.col("log_weight"))).withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, temperature: float = TEMPERATURE, share: float | None = None) -> tuple[Sampler, DataFrame]:
    """The sampler, and a written table of the id and log_weight of each row of docs; see ``resampled``."""
    flags = labels.where("quality is not null").select(labels[id_col].alias("__id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("__good")).where("__id is not null")
    flags = flags.groupBy("__id").agg(F.min("__good").alias("__good"))
    sample = docs.sparkSession.createDataFrame(flags.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(labelled).collect(), flags.schema)
    known = _flagged(docs.select(docs[id_col].alias("__doc"), docs[text_col].alias("text")), sample, "__doc")
    ratios = log_ratios(counted(known, F.col("__good")))
    own = saved(weighted(known, ratios, ["__doc", "__good"]), "weights")
    finite = F.col("log_weight") > F.lit(float("-inf"))
    if share is None:
        # an id counts once, with its least weight: at most ``labelled`` rows
        judged = own.where("__good is not null").groupBy("__doc").agg(F.min("log_weight").alias("w"), F.min("__good").alias("good")).select("w", "good").toPandas()
        cut = best_cut(judged["w"].to_numpy(float), judged["good"].to_numpy(bool))
        k = own.where(finite & (F.col("log_weight") >= F.lit(cut))).count()
    else:
        k = round(share * own.where(finite).count())
    keyed = _decided(own, temperature, float("inf"), "__doc").where("gumbel_key is not null")
    least = kth_largest(keyed, "gumbel_key", k) if k else float("inf")
    return Sampler(ratios, sample, temperature, least), own.select(F.col("__doc").alias(id_col), "log_weight")


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, temperature: float = TEMPERATURE, share: float | None = None) -> DataFrame:
    """One row per row of docs: the id, ``log_weight``, ``gumbel_key`` and ``kept``.

    labels: the same id, quality (1 good) and toxic (1 bad). Up to ``labelled`` of its rows are used, the first by a hash of
    the id; a row with a null id or quality is no label, a null toxic counts as not toxic, and an id with several rows is good
    only if all are. Both models count every row of docs. ``share``: of the documents with a token, how many are kept. Texts
    that are null or without any token have no weight (null) and aren't kept; rows of the same id and text have the same key
    and go or stay together; ties at the last place stay together. Without labels of both kinds and without a share, all
    documents with a token stay. Other columns are not read.
    """
    sampler, own = fitted(docs, labels, id_col, text_col, labelled, temperature, share)
    return _decided(own, temperature, sampler.least, id_col)


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that ``resampled`` keeps, with all their columns; decided where they are read, without a shuffle.

    Rows with null or empty texts go; repeated rows stay or go together; an empty table gives an empty one; columns of any
    name are carried along. Without labels of both kinds all rows with a token stay.
    """
    sampler, _ = fitted(docs, labels, id_col, text_col, **options)
    # names of our own for all columns, so that none can clash
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = _flagged(docs.toDF(*names), sampler.sample, own_id)
    weighed = weighted(rows, sampler.ratios, names, own_text)
    return _decided(weighed, sampler.temperature, sampler.least, own_id).where("kept").select(*names).toDF(*docs.columns)
