"""Rankings of members against observed parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.functions.stats import dot, draw, norm, z_score
from chronolex.operators.features import author_influx, centroid


def node_features(nodes: DataFrame, concepts: DataFrame, edges: DataFrame, origin: int, births: DataFrame | None = None, vectors: DataFrame | None = None, m: int = 2) -> DataFrame:
    """(region_id, node): papers of three years, velocities, degrees, share of the region next door, joint papers with neighbours in
    the region; with ``births`` (concept, coinage_year, crystallization_year) age and recent birth, with ``vectors`` (node, vec)
    the distance to the region's centroid. Each also as a z-score within the region, so that large regions don't stand out.
    """
    recent = concepts.filter(F.col("year").between(origin - 2, origin)).select("paper_id", "year", F.col("concept").alias("node")).distinct()
    n = recent.groupBy("node").agg(*[F.sum((F.col("year") == origin - i).cast("long")).alias(c) for i, c in enumerate(("n_t", "n_t1", "n_t2"))])
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    member = nodes.select("region_id", F.col("node").alias("other"))
    near = nodes.join(both, "node").join(member, ["region_id", "other"])
    inside = near.groupBy("region_id", "node").agg(F.count(F.lit(1)).alias("degree_in"))
    own, their = recent.select("node", "paper_id"), recent.select(F.col("node").alias("other"), "paper_id")
    joint = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).join(own, "node").join(their, ["other", "paper_id"]).groupBy("node", "other").agg(F.count(F.lit(1)).alias("co"))
    joint = joint.union(joint.select("other", "node", "co"))
    met = near.join(joint, ["node", "other"]).groupBy("region_id", "node").agg(F.sum("co").alias("co"))
    size = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("region_size"))
    rows = nodes.join(n, "node", "left").join(degree, "node", "left").join(inside, ["region_id", "node"], "left").join(met, ["region_id", "node"], "left").na.fill(0).join(size, "region_id")
    rows = rows.withColumn("velocity", F.col("n_t") / F.greatest(F.lit(1), F.col("n_t1"))).withColumn("velocity_2y", F.col("n_t") / F.greatest(F.lit(1.0), (F.col("n_t1") + F.col("n_t2")) / 2))
    rows = rows.withColumn("rel_size", F.col("degree_in") / F.greatest(F.lit(1), F.col("region_size") - 1)).withColumn("pace_in_region", F.col("co") / F.greatest(F.lit(1), F.col("degree_in")) / 3.0).drop("co")
    names = ["n_t", "velocity", "velocity_2y", "degree", "degree_in", "rel_size", "pace_in_region"]
    if births is not None:
        rows = rows.join(births.select(F.col("concept").alias("node"), "coinage_year", "crystallization_year"), "node", "left")
        young = F.coalesce(F.col("crystallization_year").isin(origin - m, origin - m + 1) & (F.col("crystallization_year") <= origin - (m - 1)), F.lit(False))
        rows = rows.withColumn("coinage_age", F.lit(origin) - F.coalesce("coinage_year", F.lit(origin))).withColumn("recent_birth", young.cast("int")).drop("coinage_year", "crystallization_year")
        names += ["coinage_age", "recent_birth"]
    if vectors is not None:
        placed = nodes.join(vectors, "node").select("region_id", "node", "vec")
        center = centroid(placed.select("region_id", "vec"), "region_id").filter("n >= 3")
        far = placed.join(center, "region_id").select("region_id", "node", (1 - dot(F.col("vec"), F.col("center")) / (norm(F.col("vec")) * norm(F.col("center")))).alias("emb_dist_to_centroid"))
        rows = rows.join(far, ["region_id", "node"], "left")
        names.append("emb_dist_to_centroid")
    w = Window.partitionBy("region_id")
    return rows.select("*", *[z_score(F.col(c).cast("double"), w).alias(f"z_{c}") for c in names])


def node_author_influx(nodes: DataFrame, concepts: DataFrame, authors: DataFrame, origin: int, tasks: int | None = None) -> DataFrame:
    """(region_id, node, author_influx_node): share of a node's authors of this year that it hadn't in the two before; 0 without any."""
    papers = concepts.filter(F.col("year").between(origin - 2, origin)).select(F.col("concept").alias("node"), "paper_id", "year").distinct()
    influx = author_influx(papers, authors, "node", origin, tasks)
    return nodes.join(influx, "node", "left").select("region_id", "node", F.coalesce("author_influx", F.lit(0.0)).alias("author_influx_node"))


def truths(attached: DataFrame, profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """(region_id, concept, node): the members of a birth's profile in each region that it attaches to."""
    rows = attached.filter("not orphan").select("concept", F.col("unit_id").alias("region_id"))
    return rows.join(profile.select("concept", F.col("member").alias("node")), "concept").join(nodes, ["region_id", "node"], "left_semi").select("region_id", "concept", "node")


def ranked(scored: DataFrame) -> DataFrame:
    """(region_id, node, score) with rank and region_size; ties go by name."""
    w = Window.partitionBy("region_id")
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node"))).withColumn("region_size", F.count(F.lit(1)).over(w))


def scored_by(rows: DataFrame, scorers: dict[str, str]) -> DataFrame:
    """(region_id, node, scorer, score, rank, region_size): one ranking for each scorer, from a column each, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("scorer"), F.col(column).cast("double").alias("score")) for name, column in scorers.items()]))
    long = rows.select("region_id", "node", pairs.alias("p")).select("region_id", "node", "p.scorer", "p.score")
    w = Window.partitionBy("region_id", "scorer")
    return long.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node"))).withColumn("region_size", F.count(F.lit(1)).over(w))


def scores(ranks: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """region_id, n_births, recall_at_k, hit_rate, mean_true_rank, norm_rank, avg_precision; regions of k members or fewer are left out."""
    rows = truth.join(ranks.filter(F.col("region_size") > k), ["region_id", "node"])
    w = Window.partitionBy("region_id", "concept")
    rows = rows.withColumn("n_true", F.count(F.lit(1)).over(w)).withColumn("hits", F.row_number().over(w.orderBy("rank")))
    per = rows.groupBy("region_id", "concept").agg(
        (F.sum((F.col("rank") <= k).cast("double")) / F.max("n_true")).alias("recall"), F.max((F.col("rank") <= k).cast("double")).alias("hit"),
        F.avg("rank").alias("mean_rank"), F.avg(F.col("rank") / F.col("region_size")).alias("norm_rank"), (F.sum(F.col("hits") / F.col("rank")) / F.max("n_true")).alias("ap"),
    )
    return per.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_births"), F.avg("recall").alias("recall_at_k"), F.avg("hit").alias("hit_rate"), F.avg("mean_rank").alias("mean_true_rank"), F.avg("norm_rank").alias("norm_rank"), F.avg("ap").alias("avg_precision"))


def weighted(per_region: DataFrame, *keys: str) -> DataFrame:
    """Means over regions, weighted by births; without keys one row, of nulls where there are no births."""
    mean = lambda c: (F.sum(F.col("n_births") * F.col(c)) / F.sum("n_births")).alias(c)
    return per_region.groupBy(*keys).agg(F.sum("n_births").alias("n_births"), *[mean(c) for c in ("recall_at_k", "hit_rate", "mean_true_rank", "avg_precision")])


def random_score(seed: int, *key: str) -> Column:
    return draw(seed, *[F.col(c).cast("string") for c in key])


def bootstrap(a: DataFrame, b: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """lift, low, high: ratio of births-weighted recalls, regions drawn with replacement; order statistics, not interpolated.

    a, b: (region_id, n_births, recall_at_k). Draws depend on replicate and place alone.
    """
    rows = a.join(b.select("region_id", F.col("recall_at_k").alias("base")), "region_id").select("region_id", "n_births", "recall_at_k", "base")
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("region_id")) - 1).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
    draws = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.col("i").alias("place"), "size")
    draws = draws.withColumn("i", (F.floor(draw(seed, F.col("rep").cast("string"), F.col("place").cast("string")) * F.col("size"))).cast("int")).drop("size")
    ratio = F.sum(F.col("n_births") * F.col("recall_at_k")) / F.nullif(F.sum(F.col("n_births") * F.col("base")), F.lit(0.0))
    lifts = draws.join(rows, "i").groupBy("rep").agg(ratio.alias("lift")).withColumn("r", F.row_number().over(Window.orderBy("lift", "rep")) - 1)
    at = lambda q: F.max(F.when(F.col("r") == int(q * n), F.col("lift")))
    return rows.agg(ratio.alias("lift")).select("lift", lifts.agg(at(0.025)).scalar().alias("low"), lifts.agg(at(0.975)).scalar().alias("high"))


def year_bootstrap(a: DataFrame, b: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """lift (mean), low, high: ratio of births-weighted recalls, whole years drawn with replacement, as regions of a year depend on each other.

    a, b: (origin, region_id, n_births, recall_at_k). Only sums by year are drawn from.
    """
    rows = a.join(b.select("origin", "region_id", F.col("recall_at_k").alias("base")), ["origin", "region_id"])
    years = rows.groupBy("origin").agg(F.sum(F.col("n_births") * F.col("recall_at_k")).alias("x"), F.sum(F.col("n_births") * F.col("base")).alias("y"))
    years = years.withColumn("i", F.row_number().over(Window.orderBy("origin")) - 1).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
    draws = years.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.col("i").alias("place"), "size")
    draws = draws.withColumn("i", (F.floor(draw(seed, F.col("rep").cast("string"), F.col("place").cast("string")) * F.col("size"))).cast("int")).drop("size")
    lifts = draws.join(years, "i").groupBy("rep").agg((F.sum("x") / F.greatest(F.lit(1e-9), F.sum("y"))).alias("lift")).withColumn("r", F.row_number().over(Window.orderBy("lift", "rep")) - 1)
    at = lambda q: F.max(F.when(F.col("r") == int(q * n), F.col("lift")))
    return lifts.agg(F.avg("lift").alias("lift"), at(0.025).alias("low"), at(0.975).alias("high"))


def select_best(results: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The one setting (columns ``keys``) with the best births-weighted recall on validation at k; ties go by the settings in order.

    results: (keys, k, region_id, n_births, recall_at_k) of the validation origins only.
    """
    rows = results.filter(F.col("k") == k).groupBy(*keys).agg((F.sum(F.col("n_births") * F.col("recall_at_k")) / F.sum("n_births")).alias("val_recall"))
    return rows.orderBy(F.desc(F.round("val_recall", 12)), *keys).limit(1)


def greedy_oracle(truth: DataFrame, k: int) -> DataFrame:
    """region_id, picks, oracle_recall: the k members that cover most of the births' parents, each birth weighing one; ties by name.

    A birth's recall is a sum over its parents, so the best set is the k members with the largest sums.
    """
    weight = truth.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("region_id", "concept")))
    births = truth.groupBy("region_id").agg(F.countDistinct("concept").alias("n_births"))
    gain = weight.groupBy("region_id", "node").agg(F.sum("w").alias("gain"))
    best = gain.withColumn("r", F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc(F.round("gain", 9)), "node"))).filter(F.col("r") <= k)
    out = best.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("r", "node"))).alias("p"), F.sum("gain").alias("gain")).join(births, "region_id")
    return out.select("region_id", F.col("p.node").alias("picks"), (F.col("gain") / F.col("n_births")).alias("oracle_recall"))
