"""Exact nearest neighbours of embeddings and what is read off them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import new_path, saved

#: Query rows that are sent to the other side at once, blocks of them in one plan, base rows that are scored at once, and base rows that are worth a task.
QUERY_ROWS, BLOCKS, BASE_ROWS, TASK_ROWS = 4096, 8, 1024, 2048
#: What a product in single precision may be off, for each component and unit of length; pairs that are scored in double precision at once.
ERROR, CHUNK = 1e-7, 1 << 16


def top_k(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", extra: tuple[str, ...] = (), block: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, neighbour, score (inner product, rounded to 9 digits), and extra columns of the neighbour.

    Queries go out in blocks of a bounded number of rows; each partition of the base gives its own k best for each query, so
    what is shuffled is k rows for each query and partition, never the base or the pairs. The finds of BLOCKS blocks are written
    before the next ones, so the plan doesn't grow with the queries. Rows with a null vector take no part. The search is exact,
    so its work is that of all pairs of a query and a base row. A base in a few files is dealt over tasks first, and many queries
    are written by blocks, so that a block doesn't read all of them.
    """
    spark = base.sparkSession
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-rows.count() // block))
    number = F.pmod(F.xxhash64("q"), F.lit(blocks))
    if blocks > BLOCKS:
        path = new_path(spark, "queries")
        rows.withColumn("__block", number.cast("long")).repartition("__block").write.partitionBy("__block").parquet(path)
        rows, number = spark.read.schema(f"q long, v {rows.schema['v'].dataType.simpleString()}, __block long").parquet(path), F.col("__block")
    known = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(vector).alias("v"))
    tasks = min(spark.sparkContext.defaultParallelism, known.count() // TASK_ROWS)
    if tasks > known.rdd.getNumPartitions():
        known = saved(known.repartition(tasks), "base")
    schema = "q long, c long, score double"

    def scan(shared):
        def run(batches):
            ids, q = shared.value
            with np.errstate(over="ignore"):
                small, length = q.astype(np.float32), np.sqrt((q * q).sum(axis=1))
            narrow = bool(np.isfinite(small).all())
            least = np.full(len(ids), -np.inf)  # what a row must reach to be among a query's k best so far
            held, n = [], 0

            def reduced():
                i, c, s = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((c, -s, i))
                i, c, s = i[order], c[order], s[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                last = place == k - 1
                least[i[last]] = s[last]
                return [(i[place < k], c[place < k], s[place < k])]

            for batch in batches:
                ids_of = batch.column("c").to_numpy()
                for start in range(0, batch.num_rows, BASE_ROWS):
                    c = ids_of[start : start + BASE_ROWS]
                    rows = batch.column("v").slice(start, BASE_ROWS)
                    vectors = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                    # in single precision first, with what that may be off; what may be among the best is scored in double precision
                    half = vectors.astype(np.float32)
                    longest = np.sqrt((vectors * vectors).sum(axis=1)).max()
                    # a product that single precision can't hold would be infinite there
                    if narrow and np.isfinite(half).all() and length.max() * longest < 1e37:
                        s, off = small @ half.T, length * (longest * ERROR * q.shape[1]) + 1e-9
                    else:
                        s, off = q @ vectors.T, np.full(len(ids), 1e-9)
                        s[np.isnan(s)] = -np.inf  # no score: the pair takes no part
                    # a row is no neighbour of its own id
                    low, high = np.searchsorted(ids, c), np.searchsorted(ids, c, "right")
                    for j in np.flatnonzero(high > low):
                        s[low[j] : high[j], j] = -np.inf
                    floor = np.partition(s, -k, axis=1)[:, -k] - off if n == 0 and s.shape[1] > k else least
                    # no higher than in double precision, and of the products' own kind, else all of them would be converted
                    floor = np.nextafter((floor - off).astype(s.dtype), s.dtype.type(-np.inf))
                    met = np.flatnonzero(s.max(axis=1) >= floor)
                    i, j = np.divmod(np.flatnonzero((s[met] >= floor[met, None]).ravel()), s.shape[1])
                    i = met[i]
                    i, j = (x[s[i, j] > -np.inf] for x in (i, j))
                    v = np.concatenate([np.einsum("ij,ij->i", q[i[x : x + CHUNK]], vectors[j[x : x + CHUNK]]) for x in range(0, len(i), CHUNK)] or [np.zeros(0)]).round(9)
                    kept = v >= least[i]
                    i, j, v = i[kept], j[kept], v[kept]
                    held.append((i, c[j], v))
                    n += len(i)
                    # after the first rows too: until then there is nothing to reach, and all of the next ones would count
                    if n > 2 * k * len(ids) or len(held) == 1:
                        held = reduced()
                        n = len(held[0][0])
            if n:
                i, c, s = reduced()[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(c), pa.array(s)], names=["q", "c", "score"])

        return run

    found, written = None, None
    for b in range(blocks):
        some = rows.where(number == b).select("q", "v").orderBy("q").toArrow()
        if len(some):
            vectors = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            shared = spark.sparkContext.broadcast((some["q"].to_numpy(), vectors.reshape(len(some), -1)))
            part = known.mapInArrow(scan(shared), schema)
            found = part if found is None else found.unionByName(part)
        if found is not None and b % BLOCKS == BLOCKS - 1 and b + 1 < blocks:
            found = saved(_best(found, k), "nearest")
            written = found if written is None else written.unionByName(found)
            found = None
    done = [x for x in (written, None if found is None else _best(found, k)) if x is not None]
    if not done:
        found = spark.createDataFrame([], f"{schema}, rank int")
    else:
        found = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    out = found.select(F.col("q").alias("query_id"), "rank", F.col("c").alias("neighbour"), "score")
    if not extra:
        return out
    more = base.select(F.col(key).cast("long").alias("neighbour"), *extra).dropDuplicates(["neighbour"])
    return out.join(more, "neighbour", "left").select("query_id", "rank", "neighbour", "score", *extra)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "c")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, ks: tuple[int, ...], temperature: float = 0.07, label: str = "label") -> DataFrame:
    """query_id, k, predicted: labels of the k nearest weighted by a softmax over all neighbours given; ties to the smaller."""
    whole = W.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(whole)) / temperature)
    weighed = neighbours.withColumn("e", e).withColumn("w", F.col("e") / F.sum("e").over(whole))
    per = weighed.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    sums = per.groupBy("query_id", "k", label).agg(F.round(F.sum("w"), 9).alias("w"))
    return sums.groupBy("query_id", "k").agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("predicted"))


def nearest_entropy(neighbours: DataFrame, eps: float = 1e-8) -> DataFrame:
    """One row: minus the mean logarithm of the distance to the nearest neighbour of unit vectors."""
    distance = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    return neighbours.where("rank = 1").agg((-F.avg(F.log(distance + eps))).alias("koleo"))
