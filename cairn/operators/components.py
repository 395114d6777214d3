"""Connected components of a table of links, by alternating stars (native joins and groupings, a written table each step)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.storage import saved

#: A node with more than so many links, and than one link in CROWDED_NODES, is met by a broadcast table. There are at most
#: CROWDED_NODES such nodes in a table of links, so that table is small at any size.
CROWDED_LINKS, CROWDED_NODES = 256, 8192


def _with_least(links: DataFrame, key: str, limit: int) -> DataFrame:
    """links (a > b) with m: the least b among the links whose a is this link's ``key``, null if there is none.

    Links of a crowded key stay where they are; the others are shuffled by the key.
    """
    least = links.groupBy(F.col("a").alias("__k")).agg(F.min("b").alias("m"))
    crowded = links.groupBy(F.col(key).alias("__c")).agg(F.count("*").alias("n")).where(F.col("n") > limit).join(least, F.col("__c") == F.col("__k"), "left").select("__c", "m")
    marked = links.join(F.broadcast(crowded), F.col(key) == F.col("__c"), "left")
    rest = marked.where("__c is null").select("a", "b").join(least, F.col(key) == F.col("__k"), "left").select("a", "b", "m")
    return marked.where("__c is not null").select("a", "b", "m").union(rest)


def _large(links: DataFrame, limit: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or to the node)."""
    return _with_least(links, "b", limit).select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(links: DataFrame, limit: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    found = _with_least(links, "a", limit)
    return found.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every linked node that isn't its component's smallest node.

    Repeated links, links in both directions and links of a node to itself do no harm; a node that only links to itself, and
    a null end, give no row. An empty table gives an empty one. A round needs two star steps; rounds grow with the logarithm
    of the longest chain. A node with very many links meets no single task: minima are pre-aggregated, and its links meet
    its minimum by a small broadcast table.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, limit = now, max(CROWDED_LINKS, now[0] // CROWDED_NODES)
        links = saved(_small(saved(_large(links, limit), "links"), limit), "links")
