"""Concept series and the registry of births."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.config import Config
from chronolex.operators.components import checkpoint, count_groups
from chronolex.operators.termhood import resolve


def concepts_of(events: DataFrame, merge_map: DataFrame, rule: str, origin: int | None = None) -> DataFrame:
    """events with column concept under one of three as-of rules: 'origin' (end of a given year), 'year' (end of the
    paper's year) or 'day' (the paper's own date). merge_map has one row a term, so this is an equi-join and a CASE."""
    asof = {"origin": F.make_date(F.lit(origin), F.lit(12), F.lit(31)), "year": F.make_date(F.year("v1_date"), F.lit(12), F.lit(31)), "day": F.col("v1_date")}[rule]
    rows = events.join(merge_map.select(F.col("cand").alias("term"), "cluster", "effective_date"), "term", "left")
    concept = F.coalesce(resolve(F.col("term"), F.col("cluster"), F.col("effective_date"), asof), F.col("term"))
    return rows.withColumn("concept", concept).drop("cluster", "effective_date")


def series(resolved: DataFrame) -> DataFrame:
    """concept, year, n_papers: distinct papers, so two members of a cluster in one paper count once."""
    return resolved.groupBy("concept", "year").agg(F.countDistinct("paper_id").alias("n_papers"))


def frequency_windows(counts: DataFrame, cfg: Config) -> DataFrame:
    """concept, t: years that begin m consecutive years of at least k_year papers."""
    frequent = counts.filter(F.col("n_papers") >= cfg.k_year)
    w = Window.partitionBy("concept").orderBy("year").rangeBetween(0, cfg.m - 1)
    return frequent.withColumn("run", F.count(F.lit(1)).over(w)).filter((F.col("run") == cfg.m) & (F.col("year") <= cfg.last_complete_year - cfg.m + 1)).select("concept", F.col("year").alias("t"))


def author_groups(windows: DataFrame, resolved: DataFrame, authors: DataFrame, cfg: Config) -> DataFrame:
    """concept, t, n_groups: components of the window's papers over shared authors; a paper without authors stands alone."""
    years = windows.select("concept", "t", F.explode(F.sequence("t", F.col("t") + cfg.m - 1)).alias("year"))
    return count_groups(resolved.select("concept", "year", "paper_id"), ["concept", "t"], "paper_id", authors, "author", checkpoint(years))


def crystallizations(windows: DataFrame, groups: DataFrame | None, cfg: Config) -> DataFrame:
    """concept, crystallization_year (first window with enough author groups), n_author_groups."""
    rows = windows.withColumn("n_groups", F.lit(cfg.min_groups)) if groups is None else windows.join(groups, ["concept", "t"])
    rows = rows.filter(F.col("n_groups") >= cfg.min_groups)
    return rows.groupBy("concept").agg(F.min(F.struct("t", "n_groups")).alias("f")).select("concept", F.col("f.t").alias("crystallization_year"), F.col("f.n_groups").alias("n_author_groups"))


def declines(counts: DataFrame, cry: DataFrame, cfg: Config) -> DataFrame:
    """concept, decline_year: the first year, at least m after crystallization, that begins m years below k_year; a missing year is 0."""
    last = cfg.last_complete_year - cfg.m + 1
    starts = cry.filter(F.col("crystallization_year") + cfg.m <= last).select("concept", F.explode(F.sequence(F.col("crystallization_year") + cfg.m, F.lit(last))).alias("t"))
    years = starts.select("concept", "t", F.explode(F.sequence("t", F.col("t") + cfg.m - 1)).alias("year"))
    hot = counts.filter(F.col("n_papers") >= cfg.k_year).select("concept", "year", F.lit(1).alias("hot"))
    low = years.join(hot, ["concept", "year"], "left").groupBy("concept", "t").agg(F.count("hot").alias("n_hot")).filter("n_hot = 0")
    return low.groupBy("concept").agg(F.min("t").alias("decline_year"))


def censored_concepts(counts: DataFrame, windows: DataFrame, cfg: Config) -> DataFrame:
    """Concepts without any frequency window for which a window that runs past the last complete year is frequent as far as seen."""
    recent = counts.filter((F.col("n_papers") >= cfg.k_year) & (F.col("year") > cfg.last_complete_year - cfg.m + 1) & (F.col("year") <= cfg.last_complete_year))
    return recent.filter(F.col("year") == cfg.last_complete_year).select("concept").distinct().join(windows.select("concept").distinct(), "concept", "left_anti")


def registry(counts: DataFrame, windows: DataFrame, cry: DataFrame, members: DataFrame, cfg: Config) -> DataFrame:
    """One row a concept: coinage, crystallization, decline, fate, censoring, peak and totals. members: concept, first_date."""
    seen = counts.filter(F.col("year") <= cfg.last_complete_year)
    peak = F.max(F.struct("n_papers", (-F.col("year")).alias("y")))
    total = seen.groupBy("concept").agg(peak.alias("peak"), F.sum("n_papers").alias("total_papers"))
    coined = members.groupBy("concept").agg(F.min("first_date").alias("coinage_date"))
    censored = censored_concepts(seen, windows, cfg).withColumn("cens", F.lit(True))
    rows = total.join(coined, "concept", "left").join(cry, "concept", "left").join(declines(seen, cry, cfg), "concept", "left").join(censored, "concept", "left")
    is_censored = F.coalesce("cens", F.lit(False)) & F.col("crystallization_year").isNull()
    fate = F.when(is_censored, "censored").when(F.col("crystallization_year").isNull(), "coinage_only").when(F.col("decline_year").isNotNull(), "crystallized_then_declined").otherwise("persisted")
    return rows.select(
        "concept", "coinage_date", F.year("coinage_date").alias("coinage_year"), "crystallization_year", "n_author_groups", "decline_year", fate.alias("fate"), is_censored.alias("censored"),
        (-F.col("peak.y")).alias("peak_year"), F.col("peak.n_papers").alias("peak_papers"), "total_papers",
    )


def births_per_year(reg: DataFrame) -> DataFrame:
    """crystallization_year, n_births, from the registry or from crystallizations alone."""
    return reg.filter("crystallization_year is not null").groupBy("crystallization_year").agg(F.count(F.lit(1)).alias("n_births"))


def power_gate(reg: DataFrame, origins: list[int], floor: int) -> DataFrame:
    """origin, n_births in the year after it, and whether there are too few to test on."""
    years = reg.sparkSession.createDataFrame([(t,) for t in origins], "origin int")
    n = births_per_year(reg).select((F.col("crystallization_year") - 1).alias("origin"), "n_births")
    return years.join(n, "origin", "left").select("origin", F.coalesce("n_births", F.lit(0)).alias("n_births"), (F.coalesce("n_births", F.lit(0)) < floor).alias("too_few"))
