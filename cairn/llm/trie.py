"""The trie of conversations' prefixes by Patricia construction (operator 11).

A node is a distinct sequence of first turns. Most nodes have one child and no end, so they are not made at first: conversations
are sorted by their turns, and only branch points, ends and leaves become points of a compressed tree, whose edges carry the words
of the turns between. Sums over subtrees are taken on the compressed tree; the nodes within an edge then come out of the edge,
by sums over what lies below them on it.

How it is spread:

* a turn is a 128-bit hash of its place, role and text; a prefix is known by the sum of its turns' hashes, and a conversation is cut into
  blocks of up to BLOCK turns that begin with the prefix before them, so no conversation has to fit a row;
* blocks are dealt by ranges of their order. A task turns a range into points with a stack, as in one process; where a branch
  comes about between ranges only, both know its depth beforehand from the least common depths at and behind the ranges' borders
  (a few numbers for each range). What several ranges say about a point is then added up;
* sums over subtrees take steps of doubled length towards the root, so their number is the logarithm of the tree's height.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.resampling import CRC32_SQL
from cairn.llm.shared import saved
from cairn.operators.running import running

#: Turns of a block, bytes of blocks in a range, and ids that are joined to one string before they are hashed.
BLOCK, RANGE_BYTES, IDS = 64, 16 << 20, 512
# Every conversation begins with up to three turns of the one whose id is the next lower multiple of 20.
FAMILY, HEADS = 20, 4

_LANES = [f"l{i}" for i in range(4)]
_STARTS = [f"s{i}" for i in range(4)]
_WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, d, content, words: the turns of each conversation, numbered from 1 by turn (nulls first), then by content (an MD5 of role and
    text). Null roles and texts are empty; rows with a null conversation take no part. Texts go no further than this."""
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    content = F.md5(F.concat(F.length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)))
    rows = turns.where(turns[conv].isNotNull()).select(turns[conv].cast("long").alias("conv"), turns[turn].cast("long").alias("turn"), content.alias("content"), F.regexp_count(empty(text), F.lit(_WORD)).cast("long").alias("words"))
    # a number of its own for each row, so that no crowd of equal rows shares a task
    own = rows.withColumn("own", F.monotonically_increasing_id())
    return running(own, ["conv"], [F.col("turn"), F.col("content"), F.col("own")], {"d": F.lit(1).cast("long")}).select("conv", "d", "content", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (as ``numbered`` gives them) of conversations that begin with the first h turns of the first of their family, in place of their own
    first h; h is the CRC-32 of the decimal id modulo 4. A conversation without any turn left has one row, with d = 0."""
    turns = saved(turns, "turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    lead = F.crc32(F.col("conv").cast("string")) % HEADS
    convs = sizes.select("conv", "own", lead.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("in_base")), "base", "left")
    convs = saved(convs.withColumn("given", F.least("h", F.coalesce("in_base", F.lit(0)))), "convs")
    n = F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = convs.withColumn("n", n.cast("long"))
    heads = turns.where(F.col("d") < HEADS).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "given", "n"), "base").where(F.col("d") <= F.col("given"))
    tails = turns.join(convs.select("conv", "h", "given", "n"), "conv").where(F.col("d") > F.col("h")).withColumn("d", F.col("d") - F.col("h") + F.col("given"))
    none = convs.where("n = 0").select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words"), "n")
    columns = ["conv", "d", "content", "words", "n"]
    return heads.select(*columns).unionByName(tails.select(*columns)).unionByName(none)


def with_length(turns: DataFrame) -> DataFrame:
    """Turns as ``numbered`` gives them with n, the number of turns of their conversation, as ``points`` wants them."""
    turns = saved(turns, "turns")
    return turns.join(turns.groupBy("conv").agg(F.max("d").alias("n")), "conv")


def _key(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 8, "0") for c in lanes)))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv, k, s0..s3 (the prefix before the block), seq (16 bytes a turn), words, ends (1 for a conversation's last block), key (the
    prefix up to the block's end) and depth."""
    some = turns.where("d > 0").withColumn("hash", F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "content")))
    lanes = [F.sum(F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long")).alias(c) for i, c in enumerate(_LANES)]
    rows = F.array_sort(F.collect_list(F.struct("d", "hash", "words")))
    grouped = some.groupBy("conv", F.floor((F.col("d") - 1) / block).cast("long").alias("k")).agg(rows.alias("rows"), F.max("d").alias("depth"), F.max("n").alias("n"), *lanes)
    blocks = grouped.select("conv", "k", "depth", F.unhex(F.array_join(F.transform("rows", lambda r: r["hash"]), "")).alias("seq"), F.transform("rows", lambda r: r["words"]).alias("words"), (F.col("depth") == F.col("n")).cast("long").alias("ends"), *_LANES)
    summed = running(blocks, ["conv"], [F.col("k")], {f"t{i}": F.col(c) for i, c in enumerate(_LANES)})
    whole = 1 << 32
    starts = [((F.col(f"t{i}") - F.col(f"l{i}")) % whole).alias(c) for i, c in enumerate(_STARTS)]
    blocks = summed.select("conv", "k", "depth", "seq", "words", "ends", *starts, _key([F.col(f"t{i}") % whole for i in range(4)]).alias("key"))
    zero = F.lit(0).cast("long")
    none = turns.where("d = 0").select("conv", zero.alias("k"), zero.alias("depth"), F.unhex(F.lit("")).alias("seq"), F.array().cast("array<bigint>").alias("words"), F.lit(1).cast("long").alias("ends"), *(zero.alias(c) for c in _STARTS), F.unhex(F.lit("0" * 32)).alias("key"))
    return blocks.unionByName(none)


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their beginning."""
    most = min(len(a), len(b)) // 16
    if a[: 16 * most] == b[: 16 * most]:
        return most
    at = 0
    while a[16 * at : 16 * at + 16] == b[16 * at : 16 * at + 16]:
        at += 1
    return at


def _in_order(blocks: DataFrame) -> DataFrame:
    """Distinct blocks, dealt by ranges: pid and i number ranges and blocks in them; lcp is the turns shared with the block before (-1 if
    that begins with another prefix, null for a range's first)."""
    order = ["k", *_STARTS, "seq"]
    distinct = saved(blocks.groupBy(*order).agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("least"), F.sum("ends").alias("ends")), "distinct")
    size = distinct.agg(F.sum(F.length("seq") * 2 + 128)).first()[0] or 0
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    schema = T.StructType([*distinct.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("lcp", T.LongType())])

    def run(batches):
        pid, i, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            starts = list(zip(*(batch.column(c).to_pylist() for c in order[:-1]), strict=True))
            seqs, lcp = batch.column("seq").to_pylist(), []
            for start, seq in zip(starts, seqs, strict=True):
                lcp.append(None if last is None else _shared(last[1], seq) if last[0] == start else -1)
                last = start, seq
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * len(seqs), pa.int32()), pa.array(range(i, i + len(seqs)), pa.int64()), pa.array(lcp, pa.int64())], names=schema.names)
            i += len(seqs)

    return saved(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ordered")


def _lows(values) -> list[int]:
    """The values that are less than all before them."""
    out: list[int] = []
    for v in values:
        if not out or v < out[-1]:
            out.append(v)
    return out


def borders(ordered: DataFrame) -> dict[int, tuple[list[int], list[int]]]:
    """For each range the depths at which its first and its last block share a prefix with blocks of ranges before and behind,
    that is, where points stand that the range alone may not see. A range has at most a block's turns of each; the driver keeps them and one border's blocks."""

    def lows(table: pa.Table) -> pa.Table:
        lcp = [v for v in table.sort_by("i").column("lcp").to_pylist() if v is not None]
        return pa.table({"pid": table.column("pid").slice(0, 1), "ahead": [_lows(lcp)], "behind": [_lows(reversed(lcp))]}, schema=pa.schema([("pid", pa.int32()), ("ahead", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64()))]))

    order = ["k", *_STARTS, "seq"]
    ends = ordered.groupBy("pid").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    spines = ordered.select("pid", "i", "lcp").groupBy("pid").applyInArrow(lows, "pid int, ahead array<bigint>, behind array<bigint>")
    pids, ahead, behind, meet, last = [], [], [], [], None
    for r in ends.join(spines, "pid").orderBy("pid").toLocalIterator():
        if last is not None:
            same = all(last[c] == r["first"][c] for c in order[:-1])
            meet.append(_shared(bytes(last["seq"]), bytes(r["first"]["seq"])) if same else -1)
        pids.append(r["pid"])
        ahead.append(r["ahead"])
        behind.append(r["behind"])
        last = r["last"]
    left, right = [[] for _ in pids], [[] for _ in pids]
    for p in range(1, len(pids)):
        left[p] = _lows([meet[p - 1], *behind[p - 1], *left[p - 1]])
    for p in range(len(pids) - 2, -1, -1):
        right[p] = _lows([meet[p], *ahead[p + 1], *right[p + 1]])
    return {pid: ([v for v in a if v > 0], [v for v in b if v > 0]) for pid, a, b in zip(pids, left, right, strict=True)}


_POINT = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("above", T.BinaryType()), T.StructField("top", T.LongType()), T.StructField("n", T.LongType()), T.StructField("least", T.LongType()), T.StructField("ends", T.LongType()), T.StructField("tails", T.ArrayType(T.LongType()))])


class _Range:
    """Points of a range of blocks. A frame of the stack is [depth in the block, members, least member, ends, row]."""

    def __init__(self, rows: dict[str, list], block: int):
        self.rows, self.block, self.stack, self.out = rows, block, [], []
        self.sums: tuple[int, np.ndarray] = (-1, np.zeros((1, 4), np.int64))

    def key(self, row: int, depth: int) -> bytes:
        if self.sums[0] != row:
            start = np.array([[self.rows[c][row] for c in _STARTS]], np.int64)
            turns = np.frombuffer(self.rows["seq"][row], ">u4").reshape(-1, 4).astype(np.int64)
            self.sums = row, np.concatenate((start, turns)).cumsum(axis=0) & 0xFFFFFFFF
        return self.sums[1][depth].astype(">u4").tobytes()

    def give(self, frame: list, above: int) -> None:
        depth, n, least, ends, row = frame
        words = self.rows["words"][row][above:depth]
        # words of the edge from each of its nodes down to the point
        tails = np.cumsum(np.array(words[::-1], np.int64))[::-1].tolist()
        self.out.append((self.key(row, depth), self.key(row, above), self.rows["k"][row] * self.block + above, n, least, ends, tails))

    def close(self, depth: int) -> None:
        """Gives out all points below a depth of the current path; what is left of it ends in a point there."""
        while self.stack[-1][0] > depth:
            frame = self.stack.pop()
            if self.stack[-1][0] < depth:
                self.stack.append([depth, 0, frame[2], 0, frame[4]])
            above = self.stack[-1]
            above[1] += frame[1]
            above[2] = min(above[2], frame[2])
            self.give(frame, above[0])

    def finish(self) -> None:
        """The end of the blocks behind a prefix. The prefix itself is a point of the blocks before, but for the empty one."""
        if self.stack:
            self.close(0)
            depth, n, least, ends, row = self.stack.pop()
            if self.rows["k"][row] == 0:
                self.out.append((self.key(row, 0), None, -1, n, least, ends, [0]))

    def run(self, left: list[int], right: list[int]) -> list[tuple]:
        r = self.rows
        for row, (seq, lcp, n, least, ends) in enumerate(zip(r["seq"], r["lcp"], r["n"], r["least"], r["ends"], strict=True)):
            if lcp is None or lcp < 0:
                self.finish()
                # points that only ranges before know of; the first block of the range lies under them
                self.stack = [[d, 0, least, 0, row] for d in (0, *(sorted(left) if lcp is None else ()))]
            else:
                self.close(lcp)
            depth = len(seq) // 16
            if self.stack[-1][0] == depth:
                top = self.stack[-1]
                top[1], top[2], top[3] = top[1] + n, min(top[2], least), top[3] + ends
            else:
                self.stack.append([depth, n, least, ends, row])
        for d in right if self.stack else ():
            self.close(d)
        self.finish()
        return self.out


def points(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The compressed tree: key, above (the parent's key, null for the root), top (the parent's depth, -1), n (members), least (smallest
    member), tails (for each node of the edge, the words from there to its end); and (key, conv) for the ends of conversations."""
    blocks = saved(_blocks(turns, block), "blocks")
    ordered = _in_order(blocks)
    known = ordered.sparkSession.sparkContext.broadcast(borders(ordered))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        pid = table.column("pid")[0].as_py()
        rows = {c: table.column(c).to_pylist() for c in ("k", *_STARTS, "seq", "words", "n", "least", "ends", "lcp")}
        out = _Range(rows, block).run(*known.value[pid])
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=_POINT.names)

    found = ordered.groupBy("pid").applyInArrow(run, _POINT)
    # ranges that share a point agree on its edge
    merged = found.groupBy("key").agg(F.first("above").alias("above"), F.first("top").alias("top"), F.sum("n").alias("n"), F.min("least").alias("least"), F.first("tails").alias("tails"))
    return saved(merged, "points"), blocks.where("ends = 1").select("key", "conv")


def below(tree: DataFrame) -> DataFrame:
    """key, leaves, saved: sums over each point's subtree, with its own edge; saved counts (n - 1) times the words of each node."""
    children = tree.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("kids"))
    state = tree.join(children, "key", "left").select("key", F.col("above").alias("up"), F.coalesce("kids", F.lit(0)).alias("kids"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.element_at("tails", 1)).alias("saved"))
    state = saved(state, "subtrees")
    while True:
        active = state.where("up is not null")
        gifts = active.groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = active.select("key", "up").join(state.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("up2")), "up").select("key", "up2")
        more = state.drop("up").join(gifts, "key", "left").join(above, "key", "left")
        state = saved(more.select("key", F.col("up2").alias("up"), "kids", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "subtrees")
        if not state.where("up is not null").take(1):
            return state.drop("up")


def end_digests(ends: DataFrame) -> DataFrame:
    """key, digest: SHA-256 (hex) of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are sorted by ranges and joined to strings of IDS ids; a node's strings then stream through one digest, a batch at a time, as
    SHA-256 can't be put together from parts."""

    def joined(batches):
        for batch in batches:
            keys, convs = batch.column("key").to_pylist(), batch.column("conv").to_pylist()
            at, out = 0, []
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end < at + IDS and keys[end] == keys[at]:
                    end += 1
                out.append((keys[at], convs[at], ",".join(map(str, convs[at:end]))))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.string())], names=["key", "first", "ids"])

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "digest"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = ends.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(joined, "key binary, first long, ids string")
    return strings.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, digest string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (all long) and
    ends_sha256.

    turns: conv, d (from 1 without gaps; 0 alone for a conversation without turns), content, words, n, as ``with_length`` or ``rebuilt``
    give them. Members of a node are the conversations that begin with it; those without turns are members of the root only.
    saved_tokens sums (n_convs - 1) * words over the node's subtree, what shared prefixes needn't repeat. An empty table has no nodes.
    """
    tree, ends = points(turns, block)
    sums, digests = below(tree), end_digests(ends)
    nobody = hashlib.sha256(b"").hexdigest()
    over = tree.select(F.col("key").alias("above"), F.col("least").alias("least_above"))
    rows = tree.where("above is not null").join(over, "above").unionByName(tree.where("above is null").withColumn("least_above", F.lit(None).cast("long")))
    rows = rows.join(sums, "key").join(digests, "key", "left")
    nodes = rows.select("*", F.posexplode("tails").alias("at", "tail"))
    point = F.col("at") == F.size("tails") - 1
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("top") + 1 + F.col("at")).alias("depth"), F.when(F.col("at") == 0, F.col("least_above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(point, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        # what lies below the edge, and the edge from this node on
        (F.col("saved") - (F.col("n") - 1) * (F.element_at("tails", 1) - F.col("tail"))).alias("saved_tokens"),
        F.when(point, F.coalesce("digest", F.lit(nobody))).otherwise(F.lit(nobody)).alias("ends_sha256"),
    )


TRIE_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, content) AS place FROM t),
{CRC32_SQL.format(words="SELECT DISTINCT CAST(c AS VARCHAR) AS word FROM t")},
convs AS (SELECT CAST(word AS BIGINT) AS c, crc % 4 AS h FROM crcs),
given AS (SELECT convs.c, h, p.place AS d, content, words FROM convs JOIN p ON p.c = convs.c - convs.c % 20 AND p.place <= h),
n_given AS (SELECT convs.c, h, count(d) AS g FROM convs LEFT JOIN given USING (c, h) GROUP BY convs.c, h),
r AS (SELECT c, d, content, words FROM given
  UNION ALL SELECT p.c, place - h + g AS d, content, words FROM p JOIN n_given USING (c) WHERE place > h),
x AS (SELECT c, d, words, md5(string_agg(content, ',') OVER (PARTITION BY c ORDER BY d)) AS prefix FROM r
  UNION ALL SELECT c, 0, 0, '' FROM convs),
y AS (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM x),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CASE WHEN d = last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM y GROUP BY d, prefix),
pairs AS (SELECT d, prefix, lag(prefix) OVER (PARTITION BY c ORDER BY d) AS parent FROM y),
links AS (SELECT DISTINCT d, prefix, parent FROM pairs WHERE parent IS NOT NULL),
kids AS (SELECT d - 1 AS d, parent AS prefix, count(*) AS n_children FROM links GROUP BY ALL),
leaf AS (SELECT nodes.* FROM nodes LEFT JOIN kids USING (d, prefix) WHERE n_children IS NULL),
-- a node lies on its smallest member's path, and so do all nodes above it
leaves AS (SELECT x.d, x.prefix, count(*) AS n_leaves FROM leaf JOIN x ON x.c = leaf.conv_id AND x.d <= leaf.d GROUP BY ALL),
saved AS (SELECT x.d, x.prefix, sum((n - 1) * nodes.words) AS saved_tokens FROM nodes JOIN x ON x.c = nodes.conv_id AND x.d <= nodes.d GROUP BY ALL)
SELECT nodes.conv_id, CAST(d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes LEFT JOIN links USING (d, prefix) LEFT JOIN (SELECT d + 1 AS d, prefix AS parent, conv_id FROM nodes) up USING (d, parent)
LEFT JOIN kids USING (d, prefix) JOIN leaves USING (d, prefix) JOIN saved USING (d, prefix)
"""
