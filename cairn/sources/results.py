"""Tables of results: plain types, several runs put together, written and read by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as double, everything else (truth values too) as text; arrays and maps aren't results."""
    out = []
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.BinaryType):
            raise ValueError(f"column {f.name} of type {kind.simpleString()} can't be a result")
        target = "long" if isinstance(kind, T.IntegralType) else "double" if isinstance(kind, T.FractionalType) else "string"
        out.append(F.col(f"`{f.name}`").cast(target).alias(f.name))
    return df.select(*out)


def stacked(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; missing columns are null."""
    out = plain(tables[0])
    for t in tables[1:]:
        out = out.unionByName(plain(t), allowMissingColumns=True)
    return out


def write(df: DataFrame, path: str, kind: str) -> None:
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"results of kind {kind} aren't written")
    w = plain(df).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path) if kind == "json" else w.parquet(path)


def read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if kind == "csv" else r.json(path) if kind == "json" else r.parquet(path)
