"""What the text operators share: tables in the shared folder, dealing of groups in blocks, slices of batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.storage import new_path, saved, shared_dir

__all__ = ["blocked", "new_path", "saved", "shared_dir", "slices", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: Iterable[int], limit: int) -> Iterator[slice]:
    """Slices of rows of about ``limit`` in all, one row at least."""
    start = total = at = 0
    for at, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield slice(start, at)
            start, total = at, 0
    if at > start:
        yield slice(start, at)


#: Rows of a table of crowded keys that is broadcast at most.
CROWDED = 100_000


def blocked(home: DataFrame, guest: DataFrame, keys: list[str], tie: str, home_rows: int, guest_rows: int) -> tuple[DataFrame, DataFrame]:
    """Splits both sides of a grouped comparison so that no task holds more than about home_rows and guest_rows of them.

    Every (home block, guest block) of a key becomes a group of its own, in columns hb and gb; each home row meets each
    guest row of its key exactly once. Both inputs must be cheap to read twice (written tables). Keys have no nulls.

    Only keys with more rows than a block need to be split, and there is at most one of them for each block of rows. Their
    table is broadcast, after its size is seen, so the rows of a crowded key never gather in the task of a join.
    """
    counts = [side.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name)) for side, most, name in ((home, home_rows, "n_hb"), (guest, guest_rows, "n_gb"))]
    crowded = saved(counts[0].join(counts[1], keys, "full"), "crowded")
    small = crowded.count()
    if not small:
        one = [F.lit(0).alias("hb"), F.lit(0).alias("gb")]
        return home.select("*", *one), guest.select("*", *one)
    crowded = F.broadcast(crowded) if small <= CROWDED else crowded
    slot = F.xxhash64(tie)
    n_hb, n_gb = F.coalesce("n_hb", F.lit(1)), F.coalesce("n_gb", F.lit(1))
    return (
        home.join(crowded, keys, "left").withColumn("hb", F.pmod(slot, n_hb).cast("int")).withColumn("gb", F.explode(F.sequence(F.lit(0), n_gb - 1))).drop("n_hb", "n_gb"),
        guest.join(crowded, keys, "left").withColumn("gb", F.pmod(slot, n_gb).cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), n_hb - 1))).drop("n_hb", "n_gb"),
    )
