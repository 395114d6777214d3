"""The star-schema test tables seen as points, observations, boxes, colours and pairs; each view in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.functions.storage import spread, together

OBS = "SELECT l_partkey AS pid, l_orderkey AS frame, l_returnflag AS label, l_suppkey AS py, l_linenumber AS px, l_extendedprice AS depth FROM lineitem"
PAIR = "SELECT o_orderkey AS id, o_orderkey % 50 AS image, CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS gt, CAST(o_custkey % 5 AS INT) AS pred FROM orders"
RGB = "SELECT p_partkey AS pid, CAST(p_size * 5 % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST(CAST(floor(p_retailprice) AS BIGINT) % 256 AS INT) AS b FROM part"
PALETTE = "SELECT n_nationkey AS class_id, n_name AS name, CAST(n_nationkey % 23 * 11 AS INT) AS r, CAST(n_nationkey % 23 * 37 % 256 AS INT) AS g, CAST(n_nationkey % 23 * 53 % 256 AS INT) AS b FROM nation"
BOX = """SELECT p_partkey AS ord, concat('n', p_partkey) AS node_id, p_brand AS label, CASE WHEN p_size % 10 = 0 THEN 'region' ELSE 'object' END AS kind,
  p_partkey % 40 AS n, x0, y0, z0, x0 + (p_size % 7 + 1) * 0.5 AS x1, y0 + (p_size % 5 + 1) * 0.5 AS y1, z0 + (p_size % 3 + 1) * 0.25 AS z1
  FROM (SELECT *, CAST(p_partkey * 37 % 101 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 97 AS DOUBLE) AS y0, CAST(p_size % 4 AS DOUBLE) * 0.5 AS z0 FROM part) p"""
POINT = {
    "spark": "SELECT vec_id AS pid, CAST(embedding[0] AS DOUBLE) * 10 AS x, CAST(embedding[1] AS DOUBLE) * 10 AS y, CAST(embedding[2] AS DOUBLE) * 10 AS z, label FROM embeddings",
    "sql": "SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, label FROM embeddings",
}
EVENT = {
    "spark": "SELECT event_id AS id, user_id, event_type, value, unix_micros(CAST(ts AS TIMESTAMP)) AS ts, props FROM events",
    "sql": "SELECT event_id AS id, user_id, event_type, value, epoch_us(ts) AS ts, props FROM events",
}
NODE_OF_POINT = "SELECT pid, x, y, z, label, concat(label, '_', pid % 3) AS node FROM"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str | dict[str, str], by: str | None = None) -> DataFrame:
    """A view's Spark SQL over the tables that it names; the tables are bound as arguments, nothing is registered. Where rows are
    exploded, their tables are dealt over tasks first, by the expression ``by`` if given: a column of the view that is made in the same
    words is then known to be dealt over tasks."""
    text = sql if isinstance(sql, str) else sql["spark"]
    names = [n for n in ("lineitem", "orders", "part", "nation", "embeddings", "events", "supplier", "customer") if f"FROM {n}" in text]
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    dealt = (lambda rows: together(rows, by)) if by else spread if "LATERAL VIEW" in text else lambda rows: rows
    return spark.sql(text, **{n: dealt(table(spark, sf_dir, n)) for n in names})


def ctes(held: tuple[str, ...] = (), **named: str | dict[str, str]) -> str:
    """A WITH clause; those in ``held`` are made once, whatever refers to them."""
    return "WITH " + ", ".join(f"{k} AS {'MATERIALIZED ' if k in held else ''}({v if isinstance(v, str) else v['sql']})" for k, v in named.items())
