"""As-of joins and one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, by: str, time: str = "ts", key: str = "id") -> DataFrame:
    """Left rows with the id and time of the right row nearest in time, of the same ``by``; ties to the earlier one (then the
    smaller id), none beyond the tolerance. Times are whole numbers; columns by, time and key on both sides.

    Time is cut into buckets as wide as the tolerance, and a left row meets the right rows of its own and the two
    neighbouring buckets: an equi-join, so one busy ``by`` isn't one task.
    """
    width = max(1, tolerance)
    own = left.withColumn("__b", F.floor(F.col(time) / width))
    other = right.select(F.col(by).alias("__by"), F.col(time).alias("match_ts"), F.col(key).alias("match_id")).withColumn("__near", F.explode(F.array(*(F.floor(F.col("match_ts") / width) + k for k in (-1, 0, 1)))))
    pairs = own.select(key, by, time, "__b").join(other, (F.col(by) == F.col("__by")) & (F.col("__b") == F.col("__near"))).where(F.abs(F.col(time) - F.col("match_ts")) <= tolerance)
    best = pairs.groupBy(key).agg(F.min(F.struct(F.abs(F.col(time) - F.col("match_ts")).alias("gap"), "match_ts", "match_id")).alias("best"))
    return left.join(best, key, "left").select(*left.columns, "best.match_id", "best.match_ts", "best.gap")


def greedy(pairs: DataFrame, group: str, threshold: float, row: str = "row", column: str = "column", score: str = "score") -> DataFrame:
    """One-to-one matches of each group in order of falling score (ties to smaller row, then column), from the threshold on.

    Order decides, so a group is matched in one task; a group is one frame's or one scene's candidates over the threshold."""
    kind = pairs.schema
    schema = f"{group} {kind[group].dataType.simpleString()}, {row} {kind[row].dataType.simpleString()}, {column} {kind[column].dataType.simpleString()}, {score} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, row, column], ascending=[False, True, True])
        rows, columns, kept = set(), set(), []
        for k, (r, c) in enumerate(zip(pdf[row], pdf[column], strict=True)):
            if r not in rows and c not in columns:
                rows.add(r)
                columns.add(c)
                kept.append(k)
        return pdf.iloc[kept][[group, row, column, score]]

    return pairs.where(F.col(score) >= threshold).groupBy(group).applyInPandas(run, schema)


def fused(pairs: DataFrame, group: str, threshold: float = 0.3, many: float = 0.15, row: str = "row", column: str = "column", score: str = "score") -> DataFrame:
    """The greedy matches, then, for each column left over, all rows left over with at least ``many``: each row goes to the first
    such column. part is ``one`` or ``many``."""
    one = greedy(pairs, group, threshold, row, column, score).withColumn("part", F.lit("one"))
    left = pairs.join(one.select(group, row), [group, row], "left_anti").join(one.select(group, column), [group, column], "left_anti").where(F.col(score) >= many)
    first = left.groupBy(group, row).agg(F.min_by(F.struct(column, score), column).alias("hit")).select(group, row, F.col(f"hit.{column}").alias(column), F.col(f"hit.{score}").alias(score), F.lit("many").alias("part"))
    return one.select(group, row, column, score, "part").unionByName(first)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the least summed cost that give each of the fewer rows or columns a partner (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[j] = True
            reduced = np.where(seen[1:], np.inf, cost[of[j] - 1] - u[of[j]] - v[1:])
            better = reduced < least[1:]
            least[1:][better], back[1:][better] = reduced[better], j
            open_ = np.where(seen, np.inf, least)
            open_[0] = np.inf
            k = int(np.argmin(open_))
            step = open_[k]
            u[of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = k
            if of[j] == 0:
                break
        while j:
            of[j] = of[back[j]]
            j = back[j]
    return sorted((int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j])


def optimal(costs: DataFrame, group: str, row: str = "row", column: str = "column", cost: str = "cost") -> DataFrame:
    """The assignment of least summed cost in each group; a missing pair can't be taken. A group is one image's queries and
    targets: a matrix that fits a task."""
    kind = costs.schema
    schema = f"{group} {kind[group].dataType.simpleString()}, {row} {kind[row].dataType.simpleString()}, {column} {kind[column].dataType.simpleString()}, {cost} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=row, columns=column, values=cost, aggfunc="min").sort_index().sort_index(axis=1)
        big = float(np.nansum(np.abs(table.to_numpy()))) + 1.0
        pairs = [(r, c) for r, c in assign(table.fillna(big).to_numpy(float)) if not np.isnan(table.iat[r, c])]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(pairs), row: [table.index[r] for r, _ in pairs], column: [table.columns[c] for _, c in pairs], cost: [float(table.iat[r, c]) for r, c in pairs]})

    return costs.groupBy(group).applyInPandas(run, schema)


def detections_matched(pairs: DataFrame, detections: DataFrame, truths: DataFrame, by: tuple[str, ...], thresholds: tuple[float, ...] = (0.5,), most: int = 100) -> DataFrame:
    """For each threshold, every detection (by, id, score) with the truth it takes, or null, and whether it is ignored.

    Detections go by falling score (ties to the smaller id, ``most`` a group); each takes the free truth of the largest IoU at or
    over the threshold. Truths with ignore = 1 come last, may be taken more than once, and make their detection ignored.
    pairs: by, id, truth, iou; truths: by, truth, ignore. A group is one video's or image's detections of a category. Only pairs at or
    over a threshold go through Python, many groups in a batch."""
    truth_kind = truths.schema["truth"].dataType
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    some = detections.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*by, "id", F.col("score").cast("double").alias("score"), "place")
    known = pairs.withColumn("iou", F.coalesce("iou", F.lit(0.0)).cast("double")).where(~F.isnan("iou") & (F.col("iou") >= min(thresholds)))
    known = known.join(truths.select(*by, "truth", F.coalesce("ignore", F.lit(0)).cast("int").alias("ignore")), [*by, "truth"])
    # of the truths that a detection may take, those that count come first, then by overlap, then by id; at is 1 where a group begins
    line = W.partitionBy(*by).orderBy("place", "ignore", F.col("iou").desc(), "truth")
    rows = some.join(known, [*by, "id"]).select(*by, "id", "place", F.col("truth").cast(truth_kind).alias("truth"), "iou", "ignore")
    # few bytes but much work: a number of its own keeps small partitions from being put together into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *by).withColumn("at", F.row_number().over(line))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # groups come one behind the other, each in order, and may go on in the next batch
        place, taken, done = 0, [], []
        for pdf in batches:
            hits, told = [], []
            for k, (at, own, name, overlap, ignored) in enumerate(zip(*(pdf[c].tolist() for c in ("at", "place", "truth", "iou", "ignore")), strict=True)):
                if at == 1:
                    place, taken = 0, [set() for _ in thresholds]
                if own != place:
                    place, done = own, [False] * len(thresholds)
                for i, t in enumerate(thresholds):
                    if not done[i] and overlap >= t and (ignored == 1 or name not in taken[i]):
                        done[i] = True
                        taken[i].add(name)
                        hits.append(k)
                        told.append(t)
            found = pdf.iloc[hits][[*by, "id", "place", "truth", "ignore"]]
            yield found.assign(threshold=np.array(told, float))

    taken = rows.mapInPandas(run, T.StructType([rows.schema[c] for c in (*by, "id", "place", "truth", "ignore")]).add("threshold", "double"))
    every = some.select("*", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    return every.join(taken, [*by, "id", "place", "threshold"], "left").select(*by, "threshold", "id", "score", "truth", F.coalesce(F.col("ignore") == 1, F.lit(False)).alias("ignored"))


def paired_by_name(left: DataFrame, right: DataFrame, suffix_left: str = "", suffix_right: str = "", path: str = "path") -> DataFrame:
    """Files of both sides with the same stem once their suffixes are taken off: stem, left, right."""
    def stems(df: DataFrame, suffix: str, name: str) -> DataFrame:
        stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
        kept = df.withColumn("stem", stem).where(F.col("stem").endswith(suffix)) if suffix else df.withColumn("stem", stem)
        return kept.select(F.expr(f"left(stem, length(stem) - {len(suffix)})").alias("stem"), F.col(path).alias(name))

    return stems(left, suffix_left, "left").join(stems(right, suffix_right, "right"), "stem")
