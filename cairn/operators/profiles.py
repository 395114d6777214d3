"""Profiles of categories, and which clusters are plausible under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.labels import stripped
from cairn.operators.spatial import AXES, dbscan, planarity


def cleaned_category(name: Column) -> Column:
    """A category as profiles are looked up by: without a number behind an underscore, other signs as underscores, lower case."""
    return F.lower(F.regexp_replace(stripped(F.regexp_replace(name, r"_\d+$", "")), r"[^0-9a-zA-Z_]+", "_"))


def with_profile(rows: DataFrame, groups: DataFrame, category: str = "category", default: str = "default") -> DataFrame:
    """rows with ``profile``: that of the group (columns category, profile) which names the row's category, or the default."""
    known = groups.select(F.lower(F.regexp_replace(stripped(F.col("category")), r"[^0-9a-zA-Z_]+", "_")).alias("__k"), F.col("profile").alias("__p")).dropDuplicates(["__k"])
    return rows.withColumn("__own", cleaned_category(F.col(category))).join(known, F.col("__own") == F.col("__k"), "left").withColumn("profile", F.coalesce("__p", F.lit(default))).drop("__own", "__k", "__p")


def plausible(points: DataFrame, profiles: DataFrame, by: tuple[str, ...] = ("profile", "cluster")) -> DataFrame:
    """Each cluster with its points' count, volume, largest extent, density, planarity and whether it is plausible.

    profiles: profile, max_volume, max_extent, min_density, planarity_threshold (0: not looked at), planarity_min_volume. A cluster
    is rejected if it is too large, too long or too thin, or if it is large and flatter than its profile allows. Points
    without a cluster count for none; clusters of a profile that isn't listed are left out.
    """
    own = points.where(F.col(by[-1]).isNotNull())
    extent = [F.max(a) - F.min(a) for a in AXES]
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"), *(e.alias(f"d{a}") for a, e in zip(AXES, extent, strict=True)))
    least = [F.greatest(F.col(f"d{a}"), F.lit(1e-6)) for a in AXES]
    sizes = sizes.withColumn("volume", least[0] * least[1] * least[2]).withColumn("extent", F.greatest(*(F.col(f"d{a}") for a in AXES)))
    sizes = sizes.withColumn("density", F.col("n") / F.greatest(F.col("volume"), F.lit(1e-6)))
    keyed = own.withColumn("__g", F.struct(*by))
    flat = planarity(keyed, "__g").select(*(F.col(f"__g.{c}").alias(c) for c in by), "planarity")
    both = sizes.join(flat, list(by)).join(profiles, "profile")
    too_flat = (F.col("planarity_threshold") > 0) & (F.col("volume") > F.col("planarity_min_volume")) & (F.col("planarity") > F.col("planarity_threshold"))
    good = (F.col("volume") <= F.col("max_volume")) & (F.col("extent") <= F.col("max_extent")) & (F.col("density") >= F.col("min_density")) & ~too_flat
    return both.select(*by, "n", "volume", "extent", "density", "planarity", good.alias("plausible"))


def scene_instances(points: DataFrame, eps: float, least: int, profiles: DataFrame | None = None, scene: str = "scene", key: str = "pid") -> DataFrame:
    """scene, cluster, n and box of the instances of many scenes at once: clusters of each scene's points, those of at least ``least``
    points. With profiles (points then have ``profile``) only plausible ones stay; see ``plausible``."""
    found = dbscan(points, eps, least, key, by=(scene,)).where("cluster is not null").select(key, "cluster")
    own = points.join(found, key)
    low, high = ([f(a).alias(f"{a}{k}") for a in AXES] for f, k in ((F.min, 0), (F.max, 1)))
    boxes = own.groupBy(scene, "cluster").agg(F.count("*").alias("n"), *low, *high).where(F.col("n") >= least)
    if profiles is None:
        return boxes
    kept = plausible(own, profiles).where("plausible").select("cluster").distinct()
    return boxes.join(kept, "cluster", "left_semi")
