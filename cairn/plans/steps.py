"""Queries over small steps of annotations and sampling, and over readers fed by what tasks write."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.storage import new_path
from cairn.operators import annotations, images, matching, sampling, series
from cairn.plans.registry import query
from cairn.plans.views import POINT, ctes, table, view
from cairn.sources import formats, scenes, sinks

_TAP = "SELECT p_partkey AS pid, p_partkey % 20 + 1 AS frame, CAST(p_size * 37 % 310 AS DOUBLE) / 10 AS u, CAST(p_partkey * 13 % 230 AS DOUBLE) / 10 AS v FROM part"
_GRID = {
    "spark": "SELECT s_suppkey AS frame, x, y, CAST((x * 7 + y * 11 + s_suppkey) % 29 AS DOUBLE) AS value FROM supplier LATERAL VIEW explode(sequence(0, 29)) a AS x LATERAL VIEW explode(sequence(0, 21)) b AS y WHERE s_suppkey <= 20",
    "sql": "SELECT s_suppkey AS frame, x, y, CAST((x * 7 + y * 11 + s_suppkey) % 29 AS DOUBLE) AS value FROM supplier, range(30) a(x), range(22) b(y) WHERE s_suppkey <= 20",
}


@query(
    ctes(
        ("g", "t"), p=_TAP, g=_GRID,
        t="SELECT pid, frame, CAST(floor(u) AS BIGINT) + dx AS x, CAST(floor(v) AS BIGINT) + dy AS y, (CASE WHEN dx = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dy = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM p, range(2) a(dx), range(2) b(dy)",
    )
    + " SELECT t.pid, t.frame, CASE WHEN count(*) FILTER (g.value IS NULL AND w > 0) = 0 THEN round(sum(w * coalesce(g.value, 0)), 8) END AS value FROM t LEFT JOIN g ON g.frame = t.frame AND g.x = t.x AND g.y = t.y GROUP BY 1, 2"
)
def p04_bilinear(spark, d):
    """Values between pixels, null where one of the four is missing."""
    return images.bilinear(view(spark, d, _TAP), view(spark, d, _GRID)).withColumn("value", F.round("value", 8))


@query("SELECT l_orderkey AS image FROM lineitem GROUP BY 1 HAVING bool_or(CAST(l_quantity AS BIGINT) % 3 > 0)")
def p16_uncrowded(spark, d):
    """Records of nested annotations with one at least that isn't a crowd."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("place"), F.when(F.col("l_quantity").cast("long") % 3 == 0, 1).otherwise(0).alias("iscrowd"))
    return annotations.any_uncrowded(annotations.collected(rows, "image", ["place"], ["place", "iscrowd"], "annotations")).select("image")


@query("SELECT p_partkey AS id FROM part WHERE p_size IN (1, 5, 9, 14, 23, 31, 40, 44) AND p_partkey % 7 IN (1, 2, 5) AND p_retailprice > 900 AND p_retailprice < 1500 AND p_partkey % 2 = 0")
def p18_conditions(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("video_id"), (F.col("p_partkey") % 7).alias("category_id"), F.col("p_retailprice").alias("avg_area"), (F.col("p_partkey") % 2).alias("iscrowd"))
    return annotations.by_conditions(rows, (1, 5, 9, 14, 23, 31, 40, 44), (1, 2, 5), (900, 1500), 0).select("id")


@query("WITH o AS (SELECT o_custkey AS id, list(DISTINCT o_orderkey % 9) AS l, count(DISTINCT o_orderkey % 9) AS n FROM orders WHERE o_orderkey % 9 < 8 GROUP BY 1), s AS (SELECT id, i, CASE WHEN list_contains(l, i) THEN '1' ELSE '0' END AS b FROM o, range(8) r(i)), p AS (SELECT id, list_sort(l) AS l FROM o) SELECT s.id, string_agg(b, '' ORDER BY i) AS hot, any_value((SELECT string_agg(CAST(coalesce(l[j + 1], -1) AS VARCHAR), ',' ORDER BY j) FROM range(8) q(j))) AS padded FROM s JOIN p ON s.id = p.id GROUP BY s.id")
def x15_multi_hot(spark, d):
    """Sets of labels as zeros and ones, and filled up to one length."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 9).cast("int").alias("c")).where("c < 8")
    sets = o.groupBy("id").agg(F.sort_array(F.collect_set("c")).alias("l"))
    joined = lambda c, sep: F.array_join(c.cast("array<string>"), sep)
    return sets.select("id", joined(annotations.multi_hot(F.col("l"), 8), "").alias("hot"), joined(annotations.padded(F.col("l"), F.lit(8)), ",").alias("padded"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 <= 0 OR p_size % 4 <= 0 OR p_partkey % 3 <= 0 THEN -1 ELSE p_partkey % 11 END AS instance FROM part")
def x13_emptied(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 11).alias("instance"), (F.col("p_size") % 5).alias("w"), (F.col("p_size") % 4).alias("h"), (F.col("p_partkey") % 3).alias("area"))
    return annotations.emptied_ids(rows, "instance", "w", "h", "area").select("id", "instance")


_HEX = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT)"


@query(
    "WITH v AS (SELECT user_id AS video_id, max(event_id % 40) AS last FROM events GROUP BY 1), r AS (SELECT *, " + _HEX.format("'7:' || video_id || ':ref'") + " % (last + 1) AS ref FROM v), b AS (SELECT *, greatest(0, ref - 5) AS lo, least(last, ref + 5) AS hi FROM r), s AS (SELECT video_id, i, CASE WHEN i = 0 THEN ref ELSE lo + "
    + _HEX.format("'7:' || video_id || ':' || i") + " % (hi - lo + 1) END AS frame FROM b, range(4) q(i)) SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame, i) - 1 AS INT) AS slot, frame FROM s"
)
def t10_clip_frames(spark, d):
    """A reference frame and three near it for each video."""
    frames = table(spark, d, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 40).alias("frame"))
    return sampling.clip_frames(frames, 5, 4, 7).select("video_id", "slot", "frame")


_PLACE = "row_number() OVER (ORDER BY md5('{s}:' || {k}), {k}) - 1 + " + _HEX.format("'{s}:' || {k}") + " / 4294967296"


@query("WITH a AS (SELECT 0 AS source, c_custkey AS key, (" + _PLACE.format(s=4, k="c_custkey") + ") / 0.75 AS stand FROM customer), b AS (SELECT 1 AS source, s_suppkey AS key, (" + _PLACE.format(s=5, k="s_suppkey") + ") / 0.25 AS stand FROM supplier), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT source, key, round(stand, 6) AS stand FROM u WHERE stand <= (SELECT least((SELECT max(stand) FROM a), (SELECT max(stand) FROM b)))")
def t07_mixed(spark, d):
    """Two tables in one order, three rows of the one to one of the other, until one ends."""
    sources = [(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), 0.75), (table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")), 0.25)]
    return sampling.mixed(sources, "key", 4).select("source", "key", F.round("at", 6).alias("stand"))


_ROWS, _COLUMNS = series.tile_starts(22, 8, 5), series.tile_starts(30, 12, 9)
_TILES = f"SELECT s_suppkey AS image, oy, ox, ty, tx, CAST((oy * 3 + ox + ty * 5 + tx * 7 + s_suppkey) % 31 AS DOUBLE) AS value FROM supplier"


@query(f"WITH t AS ({_TILES}, (SELECT unnest({_ROWS}) AS oy) a, (SELECT unnest({_COLUMNS}) AS ox) b, range(8) c(ty), range(12) e(tx)) SELECT image, CAST(oy + ty AS INT) AS y, CAST(ox + tx AS INT) AS x, round(avg(value), 8) AS value, count(*) AS windows FROM t GROUP BY 1, 2, 3")
def c13_stitched(spark, d):
    """Images put together from windows that overlap."""
    spread = " ".join(f"LATERAL VIEW explode({v}) q{n} AS {n}" for n, v in (("oy", f"array({', '.join(map(str, _ROWS))})"), ("ox", f"array({', '.join(map(str, _COLUMNS))})"), ("ty", "sequence(0, 7)"), ("tx", "sequence(0, 11)")))
    return series.stitched(view(spark, d, f"{_TILES} {spread}")).withColumn("value", F.round("value", 8))


@query("SELECT 'n' || p_partkey AS stem, 'a/x/n' || p_partkey || '_img.png' AS left, 'b/n' || p_partkey || '_mask.v2.png' AS right FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0")
def j14_paired_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_partkey")
    name = lambda *parts: F.concat(*(F.col("k") if x == "k" else F.lit(x) for x in parts)).alias("path")
    left = p.where("p_partkey % 3 > 0").select(name("a/x/n", "k", "_img.png"))
    right = p.where("p_partkey % 5 > 0").select(name("b/n", "k", "_mask.v2.png"))
    return matching.paired_by_name(left, right, "_img", "_mask.v2").select("stem", "left", "right")


@query(ctes(p=POINT) + " SELECT CAST(label AS VARCHAR) AS scene, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, CAST(pid % 256 AS INT) AS r FROM p")
def k01_cloud_files(spark, d):
    """Clouds written to files, one for each label, and read back."""
    path = _clouds(spark, d)
    formats.register(spark)
    return spark.read.format("pcd").load(path).select("scene", "x", "y", "z", "r")


def _clouds(spark, d) -> str:
    points = view(spark, d, POINT).select(F.col("label").cast("string").alias("scene"), "x", "y", "z", (F.col("pid") % 256).cast("int").alias("r"), F.lit(1).alias("g"), F.lit(2).alias("b"))
    path = new_path(spark, "clouds")
    sinks.write_clouds(points, path).agg(F.sum("points")).first()
    return path


@query(ctes(p=POINT, f="SELECT CAST(label AS VARCHAR) AS scene, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM p") + " SELECT scene, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM f GROUP BY scene, floor(x / 0.5), floor(y / 0.5), floor(z / 0.5)")
def s02_loaded_clouds(spark, d):
    """Clouds loaded from files, a point for each voxel."""
    return scenes.cloud(spark, _clouds(spark, d), 0.5).select("scene", *(F.round(a, 6).alias(a) for a in "xyz"), "n")


@query("SELECT s_suppkey AS ts, s_acctbal AS px, CAST(s_suppkey % 7 AS DOUBLE) AS py, CAST(0.5 AS DOUBLE) AS pz, CAST(0 AS DOUBLE) AS qx, CAST(0 AS DOUBLE) AS qy, CAST(0.25 AS DOUBLE) AS qz, CAST(1 AS DOUBLE) AS qw FROM supplier WHERE s_suppkey % 5 > 0")
def s04_pose_files(spark, d):
    """Poses written as lines of text, some of them no pose, and read back."""
    s = table(spark, d, "supplier")
    line = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("# "), F.col("s_suppkey").cast("string"))).otherwise(F.concat_ws("  ", F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")), F.col("s_acctbal").cast("string"), (F.col("s_suppkey") % 7).cast("string"), F.lit("0.5 0 0 2.5e-1 1 more")))
    path = new_path(spark, "poses")
    s.select(line.alias("value")).write.text(path)
    return formats.poses(spark, path)


@query("SELECT 's' || p_size AS scene, 'n' || p_partkey AS node_id, p_brand AS label, p_retailprice AS size FROM part")
def s14_graph_nodes(spark, d):
    """Scene graphs written as documents, a line each, and their nodes as they are read."""
    p = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("scene"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_brand").alias("label"), F.col("p_retailprice").alias("size"))
    # a scene's graph is one document by its nature
    documents = p.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("node_id", "label", "size"))).alias("nodes"))
    path = new_path(spark, "graphs")
    documents.select(F.to_json(F.struct("scene", "nodes")).alias("value")).write.text(path)
    nodes, _ = scenes.graph_documents(spark, path, "node_id string, label string, size double", "source string, target string")
    return nodes.select("scene", "node_id", "label", "size")
