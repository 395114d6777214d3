"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

A hash turns a unit vector by a fast pseudo-rotation (random signs and a Hadamard transform, three times) and takes the nearest
signed axis. A table's bucket is several such hashes in a row, more of them the more vectors there are (the last may take a part of the
axes), so that a bucket's size doesn't grow with the table. A query probes the buckets, of all tables together, whose axes lie
nearest to it. How many, a bounded sample of queries says, whose exact neighbours are found by a scan: so many that 95 % of these
neighbours are in a probed bucket. If the most that are allowed aren't enough, all queries take the exact way.

Buckets hold ids and sketches (a byte for each component), never whole vectors. The best few of what a query collides with,
by sketches, are reranked by the exact cosine on the original vectors. Where sketches can't tell the last of these few from the
k-th, or where there are fewer than k, the query meets all vectors, in blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import blocked, saved

#: Tables with one hash to a bucket, and with several; rows of a bucket on average before another hash, or a part of one, is added.
FEW_TABLES, TABLES, FILL = 8, 40, 16
#: Buckets that a query may probe in all tables; the number is set by so many queries of a dimension, so that this share of their true
#: neighbours is in a probed bucket.
MOST_PROBES, SAMPLE, REACHED = 20_000, 128, 0.95
#: Axes of a hash that probes are made of.
NEAREST_AXES = 64
#: Vectors and queries that are coded at once.
CODED, PROBING = 1024, 64
#: Candidates that are reranked, times k, and what two sketched cosines may be off together.
RERANKED, SKETCH_ERROR = 4, 0.01
#: Index rows that share a task of the comparison, and candidates and queries of a task at most.
BULK, CANDIDATES, QUERIES = 1 << 16, 1 << 17, 1 << 18
#: Tasks of the comparison at least, and vectors and queries of a task of the exact comparison.
BULKS, EXACT_CANDIDATES, EXACT_QUERIES = 16, 1 << 14, 1 << 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the length must be a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """x (rows padded with zeros to a power of two) after three rounds of signs and transform, scaled to keep lengths."""
    d = x.shape[1]
    for signs in np.random.default_rng((d, number)).choice(np.array([-1.0, 1.0], x.dtype), (3, d)):
        x = hadamard(x * signs) * x.dtype.type(d**-0.5)
    return x


def signed_axes(x: np.ndarray, number: int, axes: int | None = None) -> np.ndarray:
    """How near each row is to each of the signed axes (of the first ``axes`` ones): axis j as j, its opposite as axes + j."""
    turned = rotated(x, number)[:, :axes]
    return np.concatenate((turned, -turned), axis=1)


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


class Shape(NamedTuple):
    """The axes of each hash of a bucket, the number of tables, and the buckets that a query probes (0: none are enough)."""

    axes: tuple[int, ...]
    tables: int
    probes: int = MOST_PROBES


def plan(rows: int, dim: int) -> Shape:
    """Hashes for so many vectors of a dimension. Beyond the second, the last hash takes 1, 2, 4 .. axes, so that the number of buckets
    doubles with the rows and no step is larger."""
    d = 1 << max(0, dim - 1).bit_length()
    if rows < (2 * d) ** 1.5:
        return Shape((d,), FEW_TABLES)
    axes, buckets, part = [d, d], (2 * d) ** 2, 0
    while rows > FILL * buckets * max(1, 2 * part):
        if part == d:
            axes, buckets, part = [*axes, d], buckets * 2 * d, 0
        part = max(1, 2 * part)
    return Shape((*axes, part) if part else tuple(axes), TABLES)


def codes(x: np.ndarray, shape: Shape) -> np.ndarray:
    """The bucket of each row in each table."""
    x = x.astype(np.float32)
    out = np.zeros((len(x), shape.tables), np.int64)
    for t in range(shape.tables):
        for h, axes in enumerate(shape.axes):
            out[:, t] = out[:, t] * (2 * axes) + signed_axes(x, t * len(shape.axes) + h, axes).argmax(axis=1)
        out[:, t] = out[:, t] * shape.tables + t
    return out


def probed(x: np.ndarray, shape: Shape) -> np.ndarray:
    """For each row the buckets of all tables (fewer than ``probes`` if there are fewer) whose axes have the largest sum of nearness, largest first."""
    x = x.astype(np.float32)
    every_s, every_b = [], []
    beam = max(64, 4 * shape.probes // shape.tables)
    for t in range(shape.tables):
        score, bucket = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
        for h, axes in enumerate(shape.axes):
            near = signed_axes(x, t * len(shape.axes) + h, axes)
            near = near - near.max(axis=1, keepdims=True)  # what is lost against the bucket that the row itself is in
            take = min(NEAREST_AXES, 2 * axes) if len(shape.axes) > 1 else 2 * axes
            top = np.argpartition(-near, take - 1, axis=1)[:, :take]
            score = (score[:, :, None] + np.take_along_axis(near, top, 1)[:, None, :]).reshape(len(x), -1)
            bucket = (bucket[:, :, None] * (2 * axes) + top[:, None, :]).reshape(len(x), -1)
            if score.shape[1] > beam:
                best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                score, bucket = np.take_along_axis(score, best, 1), np.take_along_axis(bucket, best, 1)
        every_s.append(score)
        every_b.append(bucket * shape.tables + t)
    score, bucket = np.concatenate(every_s, axis=1), np.concatenate(every_b, axis=1)
    if score.shape[1] > shape.probes:
        best = np.argpartition(-score, shape.probes - 1, axis=1)[:, : shape.probes]
        score, bucket = np.take_along_axis(score, best, 1), np.take_along_axis(bucket, best, 1)
    return np.take_along_axis(bucket, np.argsort(-score, axis=1, kind="stable"), 1)


def needed(q: np.ndarray, c: np.ndarray, shape: Shape) -> np.ndarray:
    """How many probes of each row of q reach the row of c beside it; one more than all if none do."""
    out = np.zeros(len(q), np.int64)
    for a in range(0, len(q), 16):
        for i, (buckets, own) in enumerate(zip(probed(q[a : a + 16], shape), codes(c[a : a + 16], shape), strict=True)):
            at = np.flatnonzero(np.isin(buckets, own))
            out[a + i] = at[0] + 1 if len(at) else shape.probes + 1
    return out


def enough(need: np.ndarray, shape: Shape, reached: float = REACHED) -> Shape:
    """The shape with as many probes as reach that share of neighbours; with none if the most don't."""
    least = int(np.sort(need)[max(0, int(np.ceil(reached * len(need))) - 1)])
    return shape._replace(probes=least if least <= shape.probes else 0)


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as a signed byte for each component, and each row's factor back."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    return np.rint(x / scale).astype(np.int8), scale[:, 0].astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (without rounding), so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results. Any finite vectors other than zero will do."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _coded(rows: DataFrame, shapes: dict[int, Shape], querying: bool) -> DataFrame:
    """dim, bucket, rid, id, sketch, scale: a row for each bucket that a vector is in, or that a query probes."""
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("scale", T.FloatType()), T.StructField("buckets", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        for batch in batches:
            step = PROBING if querying else CODED
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                dims, vectors = part.column("dim").to_numpy(), part.column("v").to_pylist()
                buckets: list = [None] * len(vectors)
                held: list = [None] * len(vectors)
                scales = np.zeros(len(vectors), np.float32)
                for dim in np.unique(dims):
                    where = np.flatnonzero(dims == dim)
                    x = unit([vectors[i] for i in where])
                    found = (probed if querying else codes)(x, shapes[int(dim)])
                    sketch, scales[where] = sketches(x)
                    for i, b, s in zip(where, found, sketch, strict=True):
                        buckets[i], held[i] = b, s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("id"), part.column("dim"), pa.array(held, pa.binary()), pa.array(scales), pa.array(buckets, pa.list_(pa.int64()))], names=schema.names)

    return rows.select("rid", "id", "dim", "v").mapInArrow(run, schema).select("dim", "rid", "id", "sketch", "scale", F.explode("buckets").alias("bucket"))


def fitted(index: DataFrame, queries: DataFrame, k: int) -> dict[int, Shape]:
    """The shape for each dimension, with probes by the exact neighbours of up to SAMPLE queries of it: their cost is that of so many scans."""
    shapes = {r["dim"]: plan(r["n"], r["dim"]) for r in index.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    first = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("rid"), "rid"))
    sample = saved(queries.withColumn("n", first).where(F.col("n") <= SAMPLE).drop("n"), "sample")
    best = W.partitionBy("q").orderBy(F.col("score").desc(), "id", "c")
    pairs = _exact(index, sample, k).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "c")
    pairs = pairs.join(sample.select(F.col("rid").alias("q"), F.col("v").alias("qv"), "dim"), "q").join(index.select(F.col("rid").alias("c"), F.col("v").alias("cv")), "c")

    def run(frames):
        for pdf in frames:
            for dim, own in pdf.groupby("dim"):
                need = needed(unit(own["qv"].tolist()), unit(own["cv"].tolist()), shapes[int(dim)])
                yield pd.DataFrame({"dim": np.full(len(own), dim, np.int32), "need": need})

    need: dict[int, list[int]] = {}
    for r in pairs.select("dim", "qv", "cv").mapInPandas(run, "dim int, need long").collect():  # SAMPLE * k a dimension at most
        need.setdefault(r["dim"], []).append(r["need"])
    return {dim: enough(np.array(need[dim]), shape) if dim in need else shape for dim, shape in shapes.items()}


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """rid (its own for each row), id, v (array<float> as it is, others as array<double>), dim of the rows that can be compared."""
    kind = vectors.schema[vector_col].dataType
    kind = kind if isinstance(kind.elementType, T.FloatType) else T.ArrayType(T.DoubleType())
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast(kind).alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v", F.size("v").alias("dim"))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (rows for which the condition on ``id`` holds) its k nearest found: query_id, rank, vec_id, score.

    Nearest first by the cosine of the original vectors in double precision, ties to the smaller id; a query isn't its own
    neighbour. Null vectors and ids, zero vectors and those with null or non-finite parts take no part; vectors of different
    lengths aren't compared. Several rows of an id are several vectors: each is a candidate for the other, and if they are
    queries, each has its own k rows. A query for which the tables give fewer than k candidates, or more near ones than
    sketches can tell apart, meets all rows, in blocks. Of equal vectors, only the k + 1 with the smallest ids can be among
    anyone's k nearest, so no others are dealt to buckets. An empty table gives an empty one; other columns are not read.
    """
    rows = saved(usable(vectors, id_col, vector_col), "vectors")
    copies = W.partitionBy("v").orderBy("id", "rid")
    index = saved(rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "index")
    queries = rows.where(is_query)
    shapes = fitted(index, queries, k)
    total = index.count() * max((s.tables for s in shapes.values()), default=1)
    hopeless = [d for d, s in shapes.items() if not s.probes]
    bulk = F.pmod(F.xxhash64("dim", "bucket"), F.lit(max(BULKS, -(-total // BULK)))).cast("int")
    home, guest = saved(_coded(index.where(~F.col("dim").isin(hopeless)), shapes, False).withColumn("bulk", bulk), "buckets"), saved(_coded(queries.where(~F.col("dim").isin(hopeless)), shapes, True).withColumn("bulk", bulk), "probes")
    some = saved(_sketched(home, guest, k), "candidates")
    wide = F.row_number().over(W.partitionBy("q").orderBy(F.col("near").desc(), "id", "c"))
    ranked = saved(some.groupBy("q", "c", "id").agg(F.max("near").alias("near")).withColumn("place", wide).where(F.col("place") <= k * RERANKED), "ranked")
    # queries whose reranked few are cut off among equals as far as sketches can tell, or are too few: all rows, in blocks
    told = ranked.groupBy("q").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == k, F.col("near"))).alias("kth"), F.max(F.when(F.col("place") == k * RERANKED, F.col("near"))).alias("last"))
    served = told.where((F.col("n") >= k) & (F.col("last").isNull() | (F.col("last") < F.col("kth") - SKETCH_ERROR))).select(F.col("q").alias("rid"))
    rest = saved(queries.join(served, "rid", "left_anti"), "rest")
    pairs = ranked.join(served.withColumnRenamed("rid", "q"), "q").select("q", "c").join(index.select(F.col("rid").alias("c"), F.col("v").alias("cv"), "id"), "c")
    found = _scored(pairs.join(queries.select(F.col("rid").alias("q"), F.col("v").alias("qv"), F.col("id").alias("q_id")), "q"))
    if rest.take(1):
        found = found.unionByName(_exact(index, rest, k))
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "id", "c")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _best(q: np.ndarray, c: np.ndarray, near: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest of each q, ties to smaller ids, then c; each (q, c) once."""
    order = np.lexsort((c, ids, -near, q))
    _, first = np.unique(np.stack((q[order], c[order])), axis=1, return_index=True)
    order = order[np.sort(first)]
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _sketched(home: DataFrame, guest: DataFrame, k: int) -> DataFrame:
    """q, c (rid), id of c, near: for each query the best of those that it shares a bucket with, by sketches, of each task."""
    home, guest = blocked(home, guest, ["dim", "bulk"], "rid", CANDIDATES, QUERIES)
    by, most = ["dim", "bulk", "hb", "gb"], k * RERANKED

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "near": np.zeros(0, np.float32)})
        if not len(left) or not len(right):
            return empty
        left, right = left.sort_values("bucket", ignore_index=True), right.sort_values("bucket", ignore_index=True)
        lb, rb = left["bucket"].to_numpy(), right["bucket"].to_numpy()
        common = np.intersect1d(lb, rb)
        lo, hi, a, b = (np.searchsorted(x, common, side) for x in (lb, rb) for side in ("left", "right"))
        c, q, ids = left["rid"].to_numpy(), right["rid"].to_numpy(), left["id"].to_numpy()
        cs, qs = (np.frombuffer(b"".join(x["sketch"]), np.int8).reshape(len(x), -1) for x in (left, right))
        cf, qf = left["scale"].to_numpy(), right["scale"].to_numpy()
        held, n = [], 0

        def reduced(parts):
            i, j, near = (np.concatenate(x) for x in zip(*parts, strict=True))
            kept = _best(q[i], c[j], near, ids[j], most)
            return [(i[kept], j[kept], near[kept])]

        for l0, l1, r0, r1 in zip(lo.tolist(), hi.tolist(), a.tolist(), b.tolist(), strict=True):
            some = cs[l0:l1].astype(np.float32) * cf[l0:l1, None]
            for s in range(r0, r1, 1024):
                e = min(r1, s + 1024)
                near = (qs[s:e].astype(np.float32) * qf[s:e, None]) @ some.T
                near[q[s:e, None] == c[None, l0:l1]] = -np.inf
                cut = np.partition(near, -most, axis=1)[:, -most][:, None] if near.shape[1] > most else -2.0
                i, j = np.nonzero(near >= np.maximum(cut, -2.0))
                held.append((s + i, l0 + j, near[i, j]))
                n += len(i)
                if n > 1 << 20:
                    held = reduced(held)
                    n = len(held[0][0])
        if not n:
            return empty
        i, j, near = reduced(held)[0]
        return pd.DataFrame({"q": q[i], "c": c[j], "id": ids[j], "near": near})

    return home.groupBy(*by).cogroup(guest.groupBy(*by)).applyInPandas(run, "q long, c long, id long, near float")


def _scored(pairs: DataFrame) -> DataFrame:
    """q, q_id, c, id and score of pairs with both vectors (qv, cv)."""

    def run(frames):
        for pdf in frames:
            score = np.zeros(len(pdf))
            lengths = pdf["qv"].str.len().to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                score[at] = cosines(np.array(pdf["qv"].iloc[at].tolist(), np.float64), np.array(pdf["cv"].iloc[at].tolist(), np.float64))
            yield pd.DataFrame({"q": pdf["q"], "q_id": pdf["q_id"], "c": pdf["c"], "id": pdf["id"], "score": score})

    return pairs.select("q", "q_id", "c", "id", "qv", "cv").mapInPandas(run, "q long, q_id long, c long, id long, score double")


def _exact(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, q_id, c, id, score: for each query the k nearest of all rows of its dimension in each block, by exact cosines."""
    home, guest = blocked(index, queries, ["dim"], "rid", EXACT_CANDIDATES, EXACT_QUERIES)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "q_id": [], "c": [], "id": [], "score": []}).astype({"q": "int64", "q_id": "int64", "c": "int64", "id": "int64", "score": "float64"})
        left = left.sort_values(["id", "rid"], ignore_index=True)
        c, q = (_scaled(np.array(x["v"].tolist(), np.float64)) for x in (left, right))
        cn, qn = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (c, q))
        rid, q_rid = left["rid"].to_numpy(), right["rid"].to_numpy()
        out = []
        for a in range(0, len(q), 256):
            near = qn[a : a + 256] @ cn.T
            near[q_rid[a : a + 256, None] == rid[None, :]] = -np.inf
            m = min(k, near.shape[1])
            # a little below the k-th, then by what row-by-row cosines say
            least = np.partition(near, -m, axis=1)[:, -m][:, None] - 1e-9
            i, j = np.nonzero((near >= least) & (near > -np.inf))
            score = cosines(q[a + i], c[j])
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((a + i[first], j[first], score[first]))
        i, j, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"q": q_rid[i], "q_id": right["id"].to_numpy()[i], "c": rid[j], "id": left["id"].to_numpy()[j], "score": score})

    return home.groupBy("dim", "hb", "gb").cogroup(guest.groupBy("dim", "hb", "gb")).applyInPandas(run, "q long, q_id long, c long, id long, score double")
