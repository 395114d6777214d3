import numpy as np
import pytest

from cairn.operators import knn
from cairn.plans import catalog


def test_koleo_is_over_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    # ids on both sides of 400, the closest pair beyond it
    v = rng.normal(size=(30, 8))
    v[29] = v[28] * 2 + 1e-3
    ids = [*range(15), *range(395, 410)]
    spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = -np.log(np.sqrt(np.maximum(2 - 2 * s.max(axis=1), 0)) + 1e-8).mean()
    assert catalog.queries()["m15_koleo"](spark, str(tmp_path)).first().koleo == pytest.approx(want, abs=2e-6)


def test_products_beyond_single_precision_count(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(12, 4)) * 1e25
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    s = v @ v.T
    want = {(q, k + 1): c for q in range(12) for k, c in enumerate(sorted((c for c in range(12) if c != q), key=lambda c: -s[q, c])[:9])}
    assert {(r.query_id, r.rank): r.neighbour for r in knn.top_k(df, df, 9).collect()} == want
    # a vector without a number has no score and takes none from the others; many blocks of queries are written first
    odd = df.union(spark.createDataFrame([(99, [float("nan")] * 4)], df.schema))
    assert {(r.query_id, r.rank): r.neighbour for r in knn.top_k(odd, odd, 9, block=1).collect()} == want
