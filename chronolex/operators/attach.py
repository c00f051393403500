"""Attachment of births to regions, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.config import Config
from chronolex.functions.stats import hypergeom_tail


def overlaps(profile: DataFrame, nodes: DataFrame, population: DataFrame) -> DataFrame:
    """concept, region_id, overlap, region_size, profile_size, surprise = P(X >= overlap). population: one row (v)."""
    size = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("region_size"))
    drawn = profile.groupBy("concept").agg(F.count(F.lit(1)).alias("profile_size"))
    both = profile.select("concept", F.col("member").alias("node")).join(nodes, "node").groupBy("concept", "region_id").agg(F.count(F.lit(1)).alias("overlap"))
    rows = both.join(size, "region_id").join(drawn, "concept").withColumn("v", population.scalar())
    return rows.withColumn("surprise", hypergeom_tail(F.col("overlap"), F.col("v"), F.col("region_size"), F.col("profile_size"))).drop("v")


def attach(births: DataFrame, profile: DataFrame, nodes: DataFrame, population: DataFrame, cfg: Config) -> DataFrame:
    """concept, unit_id, overlap, surprise, mass, n_attachments, orphan.

    A birth attaches by overlap or by surprise and shares a mass of one among its regions; one that has a profile but no
    region is an orphan row; one without a profile has no row.
    """
    hits = overlaps(profile.join(births.select("concept"), "concept", "left_semi"), nodes, population)
    hits = hits.filter((F.col("overlap") >= cfg.attach_overlap) | (F.col("surprise") <= cfg.attach_p))
    own = profile.select("concept").distinct().join(births.select("concept"), "concept", "left_semi")
    rows = own.join(hits.select("concept", F.col("region_id").alias("unit_id"), "overlap", "surprise"), "concept", "left")
    n = F.count("unit_id").over(Window.partitionBy("concept"))
    rows = rows.withColumn("n_attachments", n)
    return rows.select("concept", "unit_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), "surprise", F.when(F.col("n_attachments") > 0, 1.0 / F.col("n_attachments")).otherwise(0.0).alias("mass"), "n_attachments", F.col("unit_id").isNull().alias("orphan"))


def targets(attached: DataFrame) -> DataFrame:
    """unit_id, births_mass: the mass of the births that attach."""
    return attached.filter("not orphan").groupBy("unit_id").agg(F.sum("mass").alias("births_mass"))


def target_mass(attached: DataFrame) -> DataFrame:
    """total_mass and n_attached births; they are equal."""
    return attached.agg(F.round(F.sum("mass"), 6).alias("total_mass"), F.countDistinct(F.when(~F.col("orphan"), F.col("concept"))).alias("n_attached"))


def dual_gate(attached: DataFrame, origins: list[int], floor: float) -> DataFrame:
    """mean_dual, per_origin, verdict: PASS if the origins have on average ``floor`` births with two regions or more, else FAIL.

    An origin without any counts as zero, so a gate always has its row.
    """
    years = attached.sparkSession.createDataFrame([(t,) for t in origins], "origin int")
    n = attached.filter("n_attachments >= 2").groupBy("origin").agg(F.countDistinct("concept").alias("n"))
    rows = years.join(n, "origin", "left").select("origin", F.coalesce("n", F.lit(0)).alias("n"))
    out = rows.agg(F.avg("n").alias("mean_dual"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("origin", "n"))), lambda r: r["n"].cast("string")), ",").alias("per_origin"))
    return out.select("mean_dual", "per_origin", F.when(F.col("mean_dual") >= floor, "PASS").otherwise("FAIL").alias("verdict"))


def history(regions: DataFrame, attached: DataFrame) -> DataFrame:
    """unit_id, confirmed_births_mass and _count for every region, zero where none attached."""
    n = attached.filter("not orphan").groupBy("unit_id").agg(F.sum("mass").alias("confirmed_births_mass"), F.count(F.lit(1)).alias("confirmed_births_count"))
    out = regions.select(F.col("region_id").alias("unit_id")).distinct().join(n, "unit_id", "left")
    return out.select("unit_id", F.coalesce("confirmed_births_mass", F.lit(0.0)).alias("confirmed_births_mass"), F.coalesce("confirmed_births_count", F.lit(0)).alias("confirmed_births_count"))
