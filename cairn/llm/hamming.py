"""Pairs of close fingerprints by vantage-point trees, and the groups that such links make.

A tree over a bounded sample of fingerprints cuts the space: at each node, what lies within tau of the vantage point goes
left, the rest right. Every fingerprint has a home leaf. By the triangle inequality, one within r of x can only be in leaves
that x reaches when at each node it also takes the other side if its distance to the vantage point is within r of tau: x is a
guest there. So each leaf, with its guests, gives all close pairs that have an end at home in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import blocked, saved

#: Fingerprints that a tree is built on at most, those that a leaf should hold, and the deepest tree.
SAMPLE, LEAF, DEEPEST = 1 << 16, 4096, 16
#: Rows of a task at most, at home and as guests.
HOME_ROWS, GUEST_ROWS = 1 << 15, 1 << 18
#: Rows that first join what is close to them, and guests of one group in one cell that are compared with other groups only.
PIVOTS, CROWD = 16, 64


class Tree(NamedTuple):
    """A full binary tree in heap order: node k has children 2k + 1 and 2k + 2."""

    depth: int
    vantage: np.ndarray
    tau: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build(sample: np.ndarray, depth: int) -> Tree:
    """At each node the vantage point is, of a few candidates, that whose distances spread most; tau is their median."""
    n = (1 << depth) - 1
    vantage, tau = np.zeros(n, np.uint64), np.full(n, 32, np.int64)
    parts = {0: np.sort(sample)}
    for k in range(n):
        part = parts.pop(k, np.zeros(0, np.uint64))
        if not len(part) and len(sample):
            vantage[k] = sample[k % len(sample)]
        if len(part):
            tried = part[:: max(1, len(part) // 8)][:8]
            found = [distance(part, v).astype(np.int64) for v in tried]
            best = max(range(len(tried)), key=lambda i: (float(found[i].std()), -i))
            vantage[k], tau[k] = tried[best], int(np.median(found[best]))
            near = found[best] <= tau[k]
            if 2 * k + 2 < n:
                parts[2 * k + 1], parts[2 * k + 2] = part[near], part[~near]
    return Tree(depth, vantage, tau)


def route(tree: Tree, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of all leaves that each fingerprint reaches; as a guest only leaves behind its home leaf, since a
    pair in two leaves needs to be found once."""
    row, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    for _ in range(tree.depth):
        d = distance(prints[row], tree.vantage[node]).astype(np.int64)
        tau = tree.tau[node]
        near = d <= tau
        left, right = d - radius <= tau, d + radius > tau
        row, node, home = (
            np.concatenate((row[left], row[right])),
            np.concatenate((2 * node[left] + 1, 2 * node[right] + 2)),
            np.concatenate(((home & near)[left], (home & ~near)[right])),
        )
    leaf = node - ((1 << tree.depth) - 1)
    own = np.zeros(len(prints), np.int64)
    own[row[home]] = leaf[home]
    kept = home | (leaf > own[row])
    return row[kept], leaf[kept], home[kept]


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; every set's root is its smallest member."""
    parent = roots(parent)
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = roots(parent)


def linked(home: np.ndarray, guest: np.ndarray, radius: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the same groups as all pairs of a home and a guest within the radius: a spanning forest.

    Both sides are uint64 arrays of shape (n, words), without repeats. A few pivots first join what is close to them, so a crowd
    of near copies is one group after one pass. Then two vantage points taken from the home rows prune: only cells of (first,
    second distance) within the radius of a guest's are compared, and no guest with what its group has already.
    """
    both = np.concatenate((home, guest))
    nodes, inverse = np.unique(both, axis=0, return_inverse=True)
    at_home, at_guest = inverse[: len(home)].ravel(), inverse[len(home) :].ravel()
    parent = np.arange(len(nodes))
    if not len(home) or not len(guest):
        return nodes[:0], nodes[:0]

    def apart(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bitwise_count(rows ^ v).sum(axis=1, dtype=np.int64)

    for p in range(0, len(home), max(1, len(home) // PIVOTS)):
        near = np.flatnonzero(apart(guest, home[p]) <= radius)
        parent = unite(parent, np.full(len(near), at_home[p]), at_guest[near])
    first = home[0]
    h1 = apart(home, first)
    second = home[np.argmin(np.abs(h1 - 32 * home.shape[1]))]
    h2, g1, g2 = apart(home, second), apart(guest, first), apart(guest, second)
    width = 64 * home.shape[1] + 1
    order = np.lexsort((h2, h1))
    key = (h1 * width + h2)[order]
    cell = g1 * width + g2
    by_cell = np.argsort(cell, kind="stable")
    starts = np.concatenate(([0], np.flatnonzero(np.diff(cell[by_cell])) + 1, [len(cell)]))
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        guests = by_cell[s:e]
        c1, c2 = int(g1[guests[0]]), int(g2[guests[0]])
        firsts = np.arange(max(0, c1 - radius), min(width - 1, c1 + radius) + 1)
        lo = np.searchsorted(key, firsts * width + max(0, c2 - radius))
        hi = np.searchsorted(key, firsts * width + min(width - 1, c2 + radius), side="right")
        found = [order[x:y] for x, y in zip(lo, hi, strict=True) if y > x]
        if not found:
            continue
        near = np.concatenate(found)
        own = parent[at_guest[guests]]
        crowds, sizes = np.unique(own, return_counts=True)
        crowds = crowds[sizes >= CROWD]
        parts = [(guests[own == c], near[parent[at_home[near]] != c]) for c in crowds]
        for some, others in [*parts, (guests[~np.isin(own, crowds)], near)]:
            if not len(others):
                continue
            step = max(1, cells // len(others))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                d = np.bitwise_count(guest[part, 0][:, None] ^ home[others, 0][None, :])
                for w in range(1, home.shape[1]):
                    d = d + np.bitwise_count(guest[part, w][:, None] ^ home[others, w][None, :])
                i, j = np.nonzero(d <= radius)
                a, b = at_guest[part[i]], at_home[others[j]]
                fresh = parent[a] != parent[b]
                if fresh.any():
                    parent = unite(parent, a[fresh], b[fresh])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return nodes[moved], nodes[parent[moved]]


def close_links(prints: DataFrame, radius: int, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """prints: distinct fp (long), a written table. Links a, b (fp, long) that make the same groups as all pairs within radius.

    The driver holds about ``sample`` fingerprints at most, drawn by a hash where they are read, from which the tree is made;
    nodes that the sample doesn't reach get vantage points all the same, as any cut is right. Leaves and their guests are dealt in blocks
    of bounded size, so a crowded leaf isn't one task. What a task gives out is at most one link for each of its rows.
    """
    spark = prints.sparkSession
    total = prints.count()
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, total) / leaf)))))
    uniform = F.xxhash64(F.lit("sample"), "fp") / F.lit(float(1 << 64)) + 0.5
    drawn = [r[0] for r in prints.select("fp").where(uniform < min(1.0, sample / max(1, total))).collect()] if depth else []
    tree = spark.sparkContext.broadcast(build(np.array(drawn, np.int64).view(np.uint64), depth))

    def routes(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 20_000):
                part = np.ascontiguousarray(fp[k : k + 20_000])
                row, at, home = route(tree.value, part.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(at.astype(np.int32)), pa.array(home)], names=["fp", "leaf", "home"])

    routed = saved(prints.select("fp").mapInArrow(routes, "fp long, leaf int, home boolean"), "routed")
    return dealt_links(routed.where("home").select("leaf", "fp"), routed.select("leaf", "fp"), ["leaf"], ["fp"], radius)


def dealt_links(home: DataFrame, guest: DataFrame, keys: list[str], words: list[str], radius: int, home_rows: int | None = None, guest_rows: int | None = None) -> DataFrame:
    """Links among the rows of the same keys, with the words of a fingerprint in columns ``words`` (long); see ``linked``.

    For one word the links' ends a and b are the fingerprints; for more, hashes of their words by ``node``.
    """
    home, guest = blocked(home, guest, keys, words[0], home_rows or HOME_ROWS, guest_rows or GUEST_ROWS)
    both = home.withColumn("at_home", F.lit(True)).unionByName(guest.withColumn("at_home", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.ascontiguousarray(pdf[words].to_numpy(np.int64)).view(np.uint64)
        at_home = pdf["at_home"].to_numpy(bool)
        a, b = linked(fp[at_home], fp[~at_home], radius)
        return pd.DataFrame({f"{side}{i}": np.ascontiguousarray(x[:, i]).view(np.int64) for side, x in (("a", a), ("b", b)) for i in range(len(words))})

    out = both.groupBy(*keys, "hb", "gb").applyInPandas(run, ", ".join(f"{side}{i} long" for side in "ab" for i in range(len(words))))
    return out.select(*(node([f"{side}{i}" for i in range(len(words))]).alias(side) for side in "ab"))


def node(words: list[str]):
    """The id of a fingerprint: itself if it is one word, else a hash."""
    return F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)
