"""Links between texts of a similarity, verified on whole sets of shingles within groups of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.hamming import roots, unite
from cairn.llm.shared import blocked, saved
from cairn.operators.components import connected

#: Bytes of shingle sets that are compared with one another in a task, and what a row costs besides its set.
BLOCK, ROW = 8 << 20, 512
#: Texts of a group of several blocks that all its blocks are compared with, and rows of a block in the comparison across blocks.
PIVOTS, ACROSS = 8, 1 << 11


def packed(shingles: np.ndarray) -> bytes:
    """The set of a text's shingles: distinct 32-bit hashes in order."""
    return np.unique(shingles.astype(np.uint32)).tobytes()


#: With more rows of other groups than this, those that can be like a row are looked up by the beginnings of their sets.
LOOKED_UP = 64


def united(sets: list[np.ndarray], parent: np.ndarray, first: int, similarity: float) -> np.ndarray:
    """parent after joining all pairs (i < first, j > i) whose sets have the similarity (shared over all members).

    Only pairs of different groups are looked at, and of these only those whose sizes allow it. Two sets (in order) of the
    similarity share at least that part of either, so their beginnings, as long as what may be missing and one more, share a
    member: where many rows are left, only rows found so are compared. Nothing is lost by either test.
    """
    sizes = np.array([len(s) for s in sets])
    begin = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    begin[sizes == 0] = 0
    table: tuple[np.ndarray, np.ndarray] | None = None
    parent = roots(parent)
    for i in range(first):
        some = i + 1 + np.flatnonzero(parent[i + 1 :] != parent[i])
        some = some[(np.minimum(sizes[some], sizes[i]) >= similarity * np.maximum(sizes[some], sizes[i])) & (sizes[some] > 0)]
        own = sets[i]
        if len(some) > LOOKED_UP:
            if table is None:
                values, owner = np.concatenate([s[:n] for s, n in zip(sets, begin, strict=True)]), np.repeat(np.arange(len(sets)), begin)
                order = np.argsort(values, kind="stable")
                table = values[order], owner[order]
            lo, hi = (np.searchsorted(table[0], own[: begin[i]], side) for side in ("left", "right"))
            met = np.zeros(len(sets), bool)
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                met[table[1][x:y]] = True
            some = some[met[some]]
        if not len(some):
            continue
        members = np.concatenate([sets[j] for j in some])
        hit = own[np.minimum(np.searchsorted(own, members), len(own) - 1)] == members
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        close = some[common >= similarity * (sizes[i] + sizes[some] - common) - 1e-9]
        parent = unite(parent, np.full(len(close), i), close)
    return parent


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(g, np.uint32) for g in pdf["grams"]]


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """members, a written table: root (a group of candidates), key (long, its own for each row) and grams (see ``packed``).
    Links a, b between keys that make the same groups as all pairs of a root with the similarity.

    Small groups share tasks. A group of several blocks is compared block by block, each with the same few pivots, so a crowd
    of near copies is one group by then; what isn't in the largest such group is then compared with all rows, in blocks.
    """
    weight = F.length("grams") + ROW
    groups = saved(members.groupBy("root").agg(F.sum(weight).alias("size"), F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks")), "groups")
    small, any_large = groups.agg(F.sum(F.when(F.col("blocks") == 1, F.col("size"))), F.coalesce(F.max("blocks") > 1, F.lit(False))).first()
    bulks = max(1, -(-(small or 0) // BLOCK))
    rows = members.join(groups.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("pivot", F.lit(False))
    if any_large:
        large = groups.where("blocks > 1").select("root", "blocks")
        chosen = members.select("root", "key").join(large, "root").groupBy("root", "blocks").agg(F.array_distinct(F.array(*(F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(PIVOTS)))).alias("keys"))
        pivots = members.join(chosen.select("root", "blocks", F.explode("keys").alias("key")), ["root", "key"])
        rows = rows.unionByName(pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pivot", F.lit(True)))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "pivot", "key"], ascending=[True, False, True], ignore_index=True)
        key, root = pdf["key"].to_numpy(), pdf["root"].to_numpy()
        sets = _sets(pdf)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(root)) + 1, [len(root)]))
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            parent = united(sets[s:e], np.arange(e - s), e - s, similarity)
            moved = np.flatnonzero(parent != np.arange(e - s))
            a.append(key[s + moved])
            b.append(key[s + parent[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    one = F.col("blocks") == 1
    links = rows.groupBy(F.when(one, F.pmod(F.xxhash64("root"), F.lit(bulks))).alias("bulk"), F.when(~one, F.col("root")).alias("of"), "block").applyInPandas(within, "a long, b long")
    if not any_large:
        return links
    links = saved(links, "links")
    label = connected(links).withColumnRenamed("root", "label")
    big = saved(
        members.join(large.select("root"), "root").join(label, F.col("key") == F.col("node"), "left").select("root", "key", "grams", F.coalesce("label", "key").alias("label")), "big"
    )
    main = big.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("root", F.col("main.label").alias("main"))
    guest = saved(big.join(main, "root"), "open")
    home, guest = blocked(guest.where("label <> main"), guest, ["root"], "key", ACROSS, ACROSS)
    both = home.withColumn("at_home", F.lit(True)).unionByName(guest.withColumn("at_home", F.lit(False)))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at_home", "key"], ascending=[False, True], ignore_index=True)
        sets = _sets(pdf)
        labels, first, own = np.unique(pdf["label"].to_numpy(), return_index=True, return_inverse=True)
        before = first[own]
        after = united(sets, before, int(pdf["at_home"].sum()), similarity)
        moved = first[after[first] != first]
        return pd.DataFrame({"a": pdf["label"].to_numpy()[moved], "b": pdf["label"].to_numpy()[after[moved]]})

    return links.unionByName(both.groupBy("root", "hb", "gb").applyInPandas(across, "a long, b long"))
