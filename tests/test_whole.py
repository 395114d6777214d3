import random

import numpy as np
import pytest

from cairn.plans import catalog


def grouped(nodes, linked):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    rng = random.Random(5)
    # few rows reach the quantities that the SQL asks for
    rows = [(i // 3, i % 3, rng.randint(1, 60), rng.randint(1, 900), float(rng.randint(1, 50))) for i in range(300)]
    path = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path, rows


def points_of(rows):
    at = {}
    for r in rows:
        at.setdefault(r[2], set()).add(r[3])
    return at


def run(spark, name, path):
    return catalog.queries()[name](spark, path).collect()


def test_components(spark, lines):
    path, rows = lines
    want = grouped({r[3] for r in rows}, [(a, b) for g in points_of(rows).values() for a in g for b in g if abs(a - b) < 40])
    assert {r.gid: r.component for r in run(spark, "c03_components", path)} == want
    assert len(set(want.values())) < len(want)


def test_fusion(spark, lines):
    path, rows = lines
    seen = {}
    for r in rows:
        seen.setdefault(r[3], set()).add(r[2])
    centre = {g: np.array([np.mean([p % 13 for p in ps]), g % 11, g % 7]) for g, ps in seen.items()}
    assert {r.gid: (r.points, round(r.cx, 6)) for r in run(spark, "a14_centroids", path)} == {g: (len(ps), round(float(centre[g][0]), 6)) for g, ps in seen.items()}
    want = grouped(seen, [(a, b) for g in points_of(rows).values() for a in g for b in g if a < b and ((centre[a] - centre[b]) ** 2).sum() < 9])
    assert {r.gid: r.object for r in run(spark, "j12_association", path)} == want
    votes = {}
    for r in rows:
        votes.setdefault(r[2], []).append(want[r[3]])
    assert {r.pid: r.object for r in run(spark, "entry_b_fusion", path)} == {p: min(set(v), key=lambda o: (-v.count(o), o)) for p, v in votes.items()}


def test_mesh_components(spark, lines):
    path, rows = lines
    corners = {r[0] * 10 + r[1]: (("p", r[2]), ("s", r[3]), ("o", r[0])) for r in rows}
    want = grouped(corners, [(f, g) for f in corners for g in corners if f < g and len(set(corners[f]) & set(corners[g])) > 1])
    assert {r.fid: r.component for r in run(spark, "c09_mesh_components", path)} == want


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4)).astype(np.float32).astype(float)
    spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    s = np.round(v @ v.T, 9)
    want = {(q, k + 1): c for q in range(40) for k, c in enumerate(sorted((c for c in range(40) if c != q), key=lambda c: (-s[q, c], c))[:20])}
    assert {(r.query_id, r.rank): r.neighbour for r in run(spark, "j15_topk_similarity_whole", str(tmp_path))} == want
    p = v[:, :3] * 10
    inside = (np.abs(p[:, None] - p[None]) < np.array([0.5, 0.5, 1.1])).all(-1)
    p_of_box = {(int(i), int(j)) for i, j in zip(*np.nonzero(inside), strict=True)}
    assert {(r.pid, r.box_id) for r in run(spark, "j09_box_join", str(tmp_path))} == p_of_box
