"""SimHash fingerprints of texts and the groups of near duplicates that they make (operator 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import tokens
from cairn.operators.components import connected
from cairn.llm.hamming import close_links, dealt_links, node, roots, unite
from cairn.llm.jaccard import packed, verified_links
from cairn.llm.shared import saved, slices

# Fixed value: the seed of a shingle's hash.
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Of XXH64 hashes of runs of words (separated by ASCII space; A-Z lower-cased), repeats included: a bit is set if it is in
    over half of them. Fewer words make one run; none give zero."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(found))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[s:e], SEED) for s, e in zip(starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(found) - k + 1)
    return tokens.simhash(hashes)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The id and fp (long, the bits of the fingerprint) of each row; no shuffle."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 4 << 20):
                fps = np.array([fingerprint(t, words) for t in texts[part.start : part.stop].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.start : part.stop], pa.array(fps.view(np.int64))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def grouped(docs: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id that links reach. Equal
    fingerprints are one node, so copies cost nothing further. Null and empty texts have the fingerprint zero and link like
    others. Repeated rows stay. A null id is never the smallest; a component of null ids alone has a null component_id.
    """
    prints = saved(fingerprinted(docs, id_col, text_col, words), "prints")
    nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = connected(close_links(nodes.select("fp"), radius))
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select(nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root"))
    of_root = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    component = labelled.join(of_root, "root").select("fp", "component_id")
    return prints.join(component, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates at a similarity, for filtering a corpus


#: How many shards each text is dealt to.
SHARDS = 6


def bits_apart(similarity: float, bits: int = 128, slack: float = 1.0) -> int:
    """Differing bits that texts of a Jaccard similarity have on average, plus ``slack`` standard deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)


def sketched(docs: DataFrame, words: int, shards: int, text_col: str = "text") -> DataFrame:
    """fp0, fp1 (a fingerprint of 128 bits over the text's distinct shingles), n (their number) and shard keys, with all
    columns of docs but the text."""
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("fp0", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    salts = [np.uint64(0xA24BAED4963EE407 * (i + 1) % (1 << 64)) for i in range(shards)]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(rest))
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 1 << 20):
                h, bounds = tokens.shingled(*tokens.hashed(texts[part.start : part.stop].to_pylist()), words)
                rows = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = np.unique(h[a:b])
                    fp = [tokens.simhash(own), tokens.simhash(tokens.mixed(own ^ np.uint64(0x5851F42D4C957F2D)))]
                    keys = [int(tokens.mixed(own ^ s).min().view(np.int64)) + i for i, s in enumerate(salts)] if len(own) else [0]
                    rows.append((*np.array(fp, np.uint64).view(np.int64).tolist(), len(own), keys))
                fp0, fp1, n, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[part.start : part.stop] for i in range(len(rest))), pa.array(fp0, pa.int64()), pa.array(fp1, pa.int64()), pa.array(n, pa.int64()), pa.array([[(k + (1 << 63)) % (1 << 64) - (1 << 63) for k in ks] for ks in keys], pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*rest, docs[text_col].alias("__text")).mapInArrow(run, schema)


#: Rows of a shard that are compared in bulk with those of many other shards, and rows of such a bulk.
FEW, BULK = 64, 1 << 11
#: A shard with more rows than this, and than one row in CROWDED_SHARDS, is known from a broadcast table (of as many rows at most).
CROWDED_ROWS, CROWDED_SHARDS = 1024, 8192
#: Rows of a task at home and as guests, in shards of more than FEW rows.
HOME_ROWS, GUEST_ROWS = 1 << 13, 1 << 16
#: Sets of up to so many shingles differ in more bits at the same similarity, as few shingles decide on each bit. Of the cases
#: that the similarity allows, 4 shingles against 5 (0.8) differ most: in each bit with a chance of 3/16.
SMALL, SMALL_SHARE = 50, 3 / 16


def radii(bits: int, similarity: float) -> tuple[int, int]:
    """Radius for all sets, and for small ones: 4.3 standard deviations over the mean at the similarity."""
    share = SMALL_SHARE
    return bits_apart(similarity, bits, 4.3), int(bits * share + 4.3 * (bits * share * (1 - share)) ** 0.5)


def shard_links(dealt: DataFrame, radius: int) -> DataFrame:
    """dealt: shard, fp0, fp1. Links (a, b) between the nodes of close fingerprints that share a shard.

    Shards of up to FEW rows are compared in bulk, others by vantage points in blocks of bounded size; in either case what is
    given out is a spanning forest, not all pairs.
    """
    dealt = saved(dealt, "dealt")
    counts = saved(dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    limit = max(CROWDED_ROWS, dealt.count() // CROWDED_SHARDS)
    crowded = F.broadcast(counts.where(F.col("n") > limit).select("shard", F.lit(True).alias("crowded")))
    marked = dealt.join(crowded, "shard", "left")
    rest = marked.where("crowded is null").drop("crowded").join(counts.where(F.col("n") <= limit), "shard")
    shared = saved(rest.unionByName(marked.where("crowded").drop("crowded").withColumn("n", F.lit(FEW + 1).cast("long"))), "shards")
    few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW).drop("n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "fp0", "fp1"], ignore_index=True)
        shard = pdf["shard"].to_numpy()
        fp = np.ascontiguousarray(pdf[["fp0", "fp1"]].to_numpy(np.int64)).view(np.uint64)
        _, own = np.unique(fp, axis=0, return_inverse=True)
        own = own.ravel()
        parent = np.arange(own.max(initial=-1) + 1)
        for lag in range(1, FEW):
            same = np.flatnonzero(shard[:-lag] == shard[lag:])
            if not len(same):
                break
            close = same[np.bitwise_count(fp[same] ^ fp[same + lag]).sum(axis=1, dtype=np.int64) <= radius]
            parent = unite(parent, own[close], own[close + lag])
        parent = roots(parent)
        of = np.zeros(len(parent), np.int64)
        of[own] = np.arange(len(own))
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        signed = fp.view(np.int64)
        a, b = signed[of[moved]], signed[of[parent[moved]]]
        return pd.DataFrame({"a0": a[:, 0], "a1": a[:, 1], "b0": b[:, 0], "b1": b[:, 1]})

    bulks = few.agg(F.ceil(F.count("*") / BULK)).first()[0] or 1
    bulk = few.groupBy(F.pmod(F.xxhash64("shard"), F.lit(int(bulks))).alias("bulk")).applyInPandas(run, "a0 long, a1 long, b0 long, b1 long")
    return bulk.select(node(["a0", "a1"]).alias("a"), node(["b0", "b1"]).alias("b")).union(dealt_links(many, many, ["shard"], ["fp0", "fp1"], radius, HOME_ROWS, GUEST_ROWS))


def shingle_sets(rows: DataFrame, words: int, text_col: str) -> DataFrame:
    """The rows with their text replaced by grams, the set of its shingles; no shuffle."""
    rest = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField("grams", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(rest))
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 1 << 20):
                h, bounds = tokens.shingled(*tokens.hashed(texts[part.start : part.stop].to_pylist()), words)
                sets = [packed(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[part.start : part.stop] for i in range(len(rest))), pa.array(sets, pa.binary())], names=schema.names)

    return rows.select(*rest, text_col).mapInArrow(run, schema)


def deduplicated(docs: DataFrame, similarity: float = 0.8, words: int = 5, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near duplicates: that with the smallest id (then the smallest hash of its text).

    Texts link if their sets of shingles have the similarity (shared over all). Candidates come from 128-bit fingerprints over
    distinct shingles, at a radius 4.3 standard deviations beyond what the similarity makes on average (a wider one among texts
    of up to SMALL shingles). At so wide a radius no triangle bound prunes, so fingerprints are first dealt to shards by minima
    of hashed shingles (a pair of similarity s shares one of k shards with chance 1 - (1 - s)**k), and vantage points work
    within shards. The groups that candidates make are then verified on whole sets; fingerprints have no say in that.

    Texts without words (null and empty ones too) are one group. Of repeated rows, and of rows with null ids in a group, one
    stays. An empty table gives an empty one; columns of any name are carried along.
    """
    # names of our own for all columns, so that none can clash
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    key = F.xxhash64(F.coalesce(F.col(own_id).cast("string"), F.lit("\0")), F.coalesce(F.md5(own_text), F.lit("\0")))
    keyed = docs.toDF(*names).withColumn("key", key)
    radius, wider = radii(128, similarity)
    sketch = saved(sketched(keyed.select(F.col(own_id).alias("id"), F.col("key").alias("row_key"), F.col(own_text).alias("text")), words, shards), "sketch")
    nodes = saved(sketch.groupBy("fp0", "fp1").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("least"), F.max("keys").alias("keys"), F.min("n").alias("n")), "nodes")
    shards_of = lambda some: some.select(F.explode("keys").alias("shard"), "fp0", "fp1")
    found = connected(shard_links(shards_of(nodes), radius).union(shard_links(shards_of(nodes.where(F.col("n") <= SMALL)), wider)))
    ends = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root")).distinct()
    grouped_nodes = nodes.withColumn("node", node(["fp0", "fp1"])).join(ends, "node", "left").select(F.col("least.row_key").alias("key"), "least", "root")
    # one row of each fingerprint, with its group of candidates; null where it is alone
    distinct = saved(keyed.join(grouped_nodes, "key").dropDuplicates(["key"]), "distinct")
    several = distinct.where("root is not null")
    members = saved(shingle_sets(several.select("root", "key", "least", own_text), words, own_text), "members")
    labels = connected(verified_links(members.drop("least"), similarity)).withColumnRenamed("root", "label")
    labelled = members.select("key", "least").join(labels, F.col("key") == F.col("node"), "left").select(F.coalesce("label", "key").alias("label"), "least")
    stays = labelled.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias("key"))
    out = distinct.where("root is null").select(*names).union(several.join(stays, "key", "left_semi").select(*names))
    return out.toDF(*docs.columns)
