"""The star tables as a dated corpus: an order is a paper, part names are terms on three levels, customers and suppliers are authors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.config import Config
from chronolex.functions.text import lemma, n_tokens, tokens
from chronolex.operators import attach, features, graph, registry
from chronolex.operators.components import checkpoint
from chronolex.operators.termhood import tag

ORIGIN, BEFORE, LABEL_TOKENS = 2000, 1997, 3
#: Papers that one task tells apart.
TASK_PAPERS = 50_000


class Baskets:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cfg(self) -> Config:
        """Frequency thresholds grow with the number of papers; the count comes from file footers."""
        return Config(k_year=max(5, self.read("orders").count() // 600), binarize_papers=4, binarize_lift=2.0)

    @cached_property
    def papers(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        return self.read("orders").select(F.col("o_orderkey").alias("paper_id"), day.alias("v1_date"), F.year(day).alias("year"), F.quarter(day).alias("quarter"), "o_custkey")

    @cached_property
    def authors(self) -> DataFrame:
        own = self.papers.select("paper_id", F.concat(F.lit("c"), "o_custkey").alias("author")).repartition(self.tasks, "paper_id")
        more = self.read("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("s"), "l_suppkey").alias("author")).repartition(self.tasks, "paper_id").distinct()
        return own.union(more)

    @cached_property
    def tasks(self) -> int:
        """How many tasks share the papers: TASK_PAPERS each at most, so that what one holds does not grow with the table."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.read("orders").count() // TASK_PAPERS))

    @cached_property
    def events(self) -> DataFrame:
        """paper_id, term, v1_date, year, quarter, once each: a paper's lines meet as one row of its terms, which is told apart where it lies."""
        names = F.array(F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type")), F.split("p_name", " ")[1])
        part = self.read("part").select("p_partkey", names.alias("names")).hint("merge")
        line = self.read("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
        own = line.join(part, "p_partkey").repartition(self.tasks, "paper_id").groupBy("paper_id").agg(F.flatten(F.collect_set("names")).alias("names"))
        rows = own.join(self.papers.drop("o_custkey").repartition(self.tasks, "paper_id"), "paper_id")
        return rows.select("paper_id", F.explode(F.array_distinct("names")).alias("term"), "v1_date", "year", "quarter")

    @cached_property
    def merge_map(self) -> DataFrame:
        """cand, cluster, effective_date; written, so that its size is known and few terms don't gather all papers in a join's tasks."""
        terms = self.read("part").select(F.explode(F.array(F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type")), F.split("p_name", " ")[1])).alias("cand")).distinct()
        ends = r" (economy|small)$"
        dated = F.when(F.col("cand").endswith(" economy"), F.to_date(F.lit("1998-06-30"))).otherwise(F.to_date(F.lit("1900-01-01")))
        cluster = F.when(n_tokens(F.col("cand")) == 3, F.regexp_replace("cand", ends, "")).otherwise(F.col("cand"))
        return checkpoint(terms.select("cand", cluster.alias("cluster"), dated.alias("effective_date")))

    def concepts(self, rule: str = "year", origin: int | None = None) -> DataFrame:
        return registry.concepts_of(self.events, self.merge_map, rule, origin)

    @cached_property
    def resolved(self) -> DataFrame:
        """Distinct (paper_id, concept, year), written once: series, windows and groups all read it."""
        return checkpoint(self.concepts().select("paper_id", "concept", "year").distinct())

    @cached_property
    def series(self) -> DataFrame:
        """One row a concept and year."""
        return checkpoint(self.resolved.groupBy("concept", "year").agg(F.count(F.lit(1)).alias("n_papers")))

    @cached_property
    def windows(self) -> DataFrame:
        return registry.frequency_windows(self.series, self.cfg)

    @cached_property
    def cry(self) -> DataFrame:
        buyers = self.papers.select("paper_id", F.col("o_custkey").alias("author"))
        groups = registry.author_groups(self.windows, self.resolved, buyers, self.cfg)
        return checkpoint(registry.crystallizations(self.windows, groups, self.cfg))

    @cached_property
    def members(self) -> DataFrame:
        first = self.events.groupBy("term").agg(F.min("v1_date").alias("first_date"))
        return first.join(self.merge_map.withColumnRenamed("cand", "term"), "term").select(F.col("cluster").alias("concept"), "term", "first_date")

    @cached_property
    def registry(self) -> DataFrame:
        return registry.registry(self.series, self.windows, self.cry, self.members, self.cfg)

    @cached_property
    def labels(self) -> DataFrame:
        """Concepts of the finest level only, for graphs whose nodes don't contain each other; not written, so that a unit's years reach the scan."""
        return self.events.filter(n_tokens(F.col("term")) == LABEL_TOKENS).withColumnRenamed("term", "concept")

    def edges(self, origin: int) -> DataFrame:
        return graph.project(self.labels, origin, self.cfg)

    def strong(self, origin: int) -> DataFrame:
        return graph.binarize(self.edges(origin), self.cfg.binarize_papers, self.cfg.binarize_lift)

    def regions(self, origin: int, k: int = 3) -> DataFrame:
        return graph.regions(self.strong(origin), k).withColumn("region_id", F.element_at("members", 1))

    def blocks(self) -> DataFrame:
        """Regions that need no graph: labels by the second word of the name. (region_id, node)."""
        return self.labels.select(F.split("concept", " ")[1].alias("region_id"), F.col("concept").alias("node")).distinct()

    @cached_property
    def label_births(self) -> DataFrame:
        """concept, coinage_year, crystallization_year (null where there is none) of every label."""
        own = registry.series(self.labels)
        cry = registry.frequency_windows(own, self.cfg).groupBy("concept").agg(F.min("t").alias("crystallization_year"))
        return own.groupBy("concept").agg(F.min("year").alias("coinage_year")).join(cry, "concept", "left")

    @cached_property
    def vectors(self) -> DataFrame:
        """node, vec: each label has the vector that its least part key falls on."""
        keys = self.read("part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("node")).agg(F.min("p_partkey").alias("pk"))
        table = self.read("embeddings")
        size = table.agg(F.count(F.lit(1)).alias("n")).scalar()
        return keys.withColumn("vec_id", F.col("pk") % size).join(table.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("node", "vec")

    def two(self) -> DataFrame:
        """Two overlapping systems of regions: by the second and by the first word of the name."""
        return self.blocks().union(self.blocks().select(F.concat(F.lit("x "), F.split("node", " ")[0]), "node"))

    def weighted(self, origin: int) -> DataFrame:
        """The binarised graph's edges with their weights."""
        return self.edges(origin).filter((F.col("n_papers") >= self.cfg.binarize_papers) & (F.col("lift") >= self.cfg.binarize_lift)).select("u", "v", "weight")

    def attached_at(self, origin: int) -> DataFrame:
        """Births of the two years after an origin, attached to the overlapping regions."""
        own = registry.frequency_windows(registry.series(self.labels), self.cfg).groupBy("concept").agg(F.min("t").alias("t"))
        births = own.filter(F.col("t").between(origin + 1, origin + 2)).select("concept")
        profile = features.profiles(self.labels, births, self.cfg.with_(profile_min_count=2))
        return attach.attach(births, profile, self.two(), self.population(origin), self.cfg).withColumn("origin", F.lit(origin))

    @cached_property
    def births(self) -> DataFrame:
        """Labels that reach the yearly threshold for the first time in the two years after BEFORE."""
        own = registry.series(self.labels)
        return registry.frequency_windows(own, self.cfg).groupBy("concept").agg(F.min("t").alias("t")).filter(F.col("t").between(BEFORE + 1, BEFORE + 2)).select("concept")

    @cached_property
    def profiles(self) -> DataFrame:
        return checkpoint(features.profiles(self.labels, self.births, self.cfg.with_(profile_min_count=2)))

    def population(self, origin: int) -> DataFrame:
        return graph.window_papers(self.labels, origin, self.cfg).agg(F.countDistinct("concept").alias("v"))

    @cached_property
    def attached(self) -> DataFrame:
        return checkpoint(attach.attach(self.births, self.profiles, self.blocks(), self.population(BEFORE), self.cfg))

    @cached_property
    def surface(self) -> DataFrame:
        """id, v1_date, words (as they stand in the text) of the text table."""
        day = F.date_add(F.lit("2016-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(3650)).cast("int"))
        return self.read("documents").select(F.col("doc_id").alias("id"), day.alias("v1_date"), tokens(F.col("text")).alias("words"))

    @cached_property
    def documents(self) -> DataFrame:
        """id, v1_date, words (lemmas, and signs as they are) of the text table."""
        return self.surface.withColumn("words", F.transform("words", lambda w: lemma(w)))

    @cached_property
    def defining(self) -> DataFrame:
        """id, v1_date, text: the documents, each with a definition of its first three longer words' initials put after it."""
        words = F.slice(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0)), 1, 3)
        short = F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
        clause = F.when(F.size(words) == 3, F.concat(F.lit(" . In "), F.array_join(words, " "), F.lit(" ("), short, F.lit("s) we see")))
        day = F.date_add(F.lit("2016-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(3650)).cast("int"))
        return self.read("documents").select(F.col("doc_id").alias("id"), day.alias("v1_date"), F.concat("text", F.coalesce(clause, F.lit(""))).alias("text"))

    @cached_property
    def tagged(self) -> DataFrame:
        words = F.col("words")
        return self.documents.select("id", F.year("v1_date").alias("year"), words.alias("lemmas"), F.transform(words, lambda w: tag(w)).alias("pos"))
