"""Event store, yearly co-occurrence graphs and their regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.config import Config
from chronolex.functions.text import contains
from chronolex.operators.components import checkpoint, label_components

#: Steps of the guard's paper threshold; beyond the last the graph is refused.
GUARD_MOST = 40
#: Rounds in which edges without enough triangles are left out before cliques are joined.
PRUNE = 3


def event_store(postings: DataFrame, values: DataFrame, verdicts: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """(paper_id, term, v1_date, year) of terms over the C-value floor and not judged out; terms, since concepts depend on time."""
    rows = postings.join(values.filter(F.col("c_value") > floor).select(F.col("cand").alias("term")), "term", "left_semi")
    if verdicts is not None:
        rows = rows.join(verdicts.filter("verdict = 'DROP'").select("term"), "term", "left_anti")
    return rows.select("paper_id", "term", "v1_date", "year")


def window_papers(concepts: DataFrame, origin: int, cfg: Config) -> DataFrame:
    """Distinct (paper_id, concept) of the trailing window of years."""
    return concepts.filter(F.col("year").between(origin - cfg.graph_window + 1, origin)).select("paper_id", "concept").distinct()


def capped(pairs: DataFrame, cfg: Config) -> DataFrame:
    """At most ``cap`` concepts a paper: the rarest by papers in the window, then by name."""
    df = pairs.groupBy("concept").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("paper_id").orderBy("df", "concept")
    return pairs.join(df, "concept").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cfg.cap).select("paper_id", "concept")


def paper_pairs(papers: DataFrame) -> DataFrame:
    """paper_id, u < v, share: a paper's pairs without those of which one name contains the other; a paper's shares sum to 1."""
    other = papers.select("paper_id", F.col("concept").alias("v"))
    pairs = papers.withColumnRenamed("concept", "u").join(other, "paper_id").filter("u < v").filter(~contains(F.col("u"), F.col("v")))
    return pairs.withColumn("share", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("paper_id")))


def project(concepts: DataFrame, origin: int, cfg: Config) -> DataFrame:
    """u, v, weight, n_papers, lift. Lift takes joint papers after the cap, and each concept's papers before it."""
    every = window_papers(concepts, origin, cfg)
    edges = paper_pairs(capped(every, cfg)).groupBy("u", "v").agg(F.sum("share").alias("weight"), F.count(F.lit(1)).alias("n_papers"))
    d = every.groupBy("concept").agg(F.count(F.lit(1)).alias("d"))
    total = every.agg(F.countDistinct("paper_id").alias("total"))
    edges = edges.join(d.select(F.col("concept").alias("u"), F.col("d").alias("du")), "u").join(d.select(F.col("concept").alias("v"), F.col("d").alias("dv")), "v").withColumn("total", total.scalar())
    return edges.select("u", "v", "weight", "n_papers", (F.col("n_papers") * F.col("total") / (F.col("du") * F.col("dv"))).alias("lift"))


def mass(concepts: DataFrame, origin: int, cfg: Config) -> DataFrame:
    """total_weight and n_papers that have a pair; they are equal."""
    pairs = paper_pairs(capped(window_papers(concepts, origin, cfg), cfg))
    return pairs.agg(F.round(F.sum("share"), 6).alias("total_weight"), F.countDistinct("paper_id").alias("n_papers"))


def binarize(edges: DataFrame, papers: int, lift: float, rule: str = "n_papers") -> DataFrame:
    strong = F.col("n_papers") >= papers if rule == "n_papers" else F.col("weight") >= 1.0
    return edges.filter(strong & (F.col("lift") >= lift)).select("u", "v")


def graph_stats(edges: DataFrame, cfg: Config) -> DataFrame:
    """edges_weighted, nodes_in_graph, edges_binarized, nodes_binarized of a projected graph, in one pass over its edges."""
    strong = (F.col("n_papers") >= cfg.binarize_papers) & (F.col("lift") >= cfg.binarize_lift)
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), strong.alias("strong")).groupBy("node").agg(F.max("strong").alias("strong"), F.count(F.lit(1)).alias("d"), F.count_if("strong").alias("s"))
    return ends.agg(
        F.floor(F.sum("d") / 2).alias("edges_weighted"), F.count(F.lit(1)).alias("nodes_in_graph"), F.floor(F.coalesce(F.sum("s"), F.lit(0)) / 2).alias("edges_binarized"), F.count_if("strong").alias("nodes_binarized"),
    )


def _in_triangles(edges: DataFrame, least: int) -> DataFrame:
    near = lambda x, y: edges.select(F.col("u").alias(x), F.col("v").alias(y))
    corners = near("u", "v").join(near("v", "w"), "v").join(near("u", "w"), ["u", "w"])
    side = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    sides = corners.select(F.explode(F.array(side("u", "v"), side("v", "w"), side("u", "w"))).alias("e")).select("e.*")
    return sides.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("u", "v")


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """members: sorted arrays of all k-cliques of edges u < v, by k - 2 joins over oriented edges.

    An edge of a k-clique lies in k - 2 triangles, so edges in fewer are left out first; this is repeated while it helps.
    """
    edges = checkpoint(edges) if k > 3 else edges
    for _ in range(PRUNE if k > 3 else 0):
        rest = checkpoint(_in_triangles(edges, k - 2))
        before, after = edges.count(), rest.count()
        edges = rest
        if before == after:
            break
    found = edges.select(F.array("u", "v").alias("members"))
    for size in range(2, k):
        last = edges.select(F.col("u").alias("_a"), F.col("v").alias("_b"))
        found = found.join(last, F.element_at("members", -1) == F.col("_a"))
        for i in range(size - 1):
            near = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
            found = found.join(near, (F.col("members")[i] == F.col("_u")) & (F.col("_b") == F.col("_v")), "left_semi")
        found = found.select(F.concat("members", F.array("_b")).alias("members"))
    return found


def percolate(edges: DataFrame, k: int) -> DataFrame:
    """region (smallest clique's number), node: unions of k-cliques that share k - 1 nodes; regions overlap."""
    rows = checkpoint(cliques(edges, k).withColumn("clique", F.array_join("members", "\u0001")))
    faces = rows.select("clique", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.array_join(F.concat(F.slice("members", F.lit(1), i - 1), F.slice("members", i + 1, F.lit(k))), "\u0001"))).alias("face"))
    hub = faces.groupBy("face").agg(F.min("clique").alias("first"))
    links = faces.join(hub, "face").select(F.col("clique").alias("a"), F.col("first").alias("b"))
    labels = label_components(links.filter("a != b").distinct(), rows.select("clique"))
    return rows.join(labels.withColumnRenamed("node", "clique"), "clique").select(F.col("root").alias("region"), F.explode("members").alias("node")).distinct()


def regions(edges: DataFrame, k: int) -> DataFrame:
    """region_no (by size, then members), size, members."""
    rows = percolate(edges, k).groupBy("region").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))
    order = Window.orderBy(F.desc("size"), F.array_join("members", "\u0001"))
    return rows.select((F.row_number().over(order) - 1).alias("region_no"), "size", "members")


def guarded_regions(edges: DataFrame, k: int, cfg: Config) -> tuple[DataFrame, int]:
    """Regions at the first paper threshold at which the largest holds no more than its share of the nodes, and that threshold."""
    least = cfg.binarize_papers
    while True:
        strong = checkpoint(binarize(edges, least, cfg.binarize_lift))
        found = checkpoint(regions(strong, k))
        nodes = strong.select("u").union(strong.select("v")).distinct().count()
        largest = found.agg(F.max("size")).first()[0] or 0
        if not nodes or largest / nodes <= cfg.max_region_share:
            return found, least
        least = max(least + 1, int(least * 1.4))
        if least > GUARD_MOST:
            raise ValueError("one region holds most of the graph at every threshold")


def lineage(now: DataFrame, before: DataFrame, least: float) -> DataFrame:
    """region_id, parent_id, jaccard, event, from (region_id, members) of two origins: best earlier region by Jaccard, ties by name."""
    a = now.select("region_id", F.explode("members").alias("node"), F.size("members").alias("na"))
    b = before.select(F.col("region_id").alias("parent_id"), F.explode("members").alias("node"), F.size("members").alias("nb"))
    both = a.join(b, "node").groupBy("region_id", "parent_id", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    both = both.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    w = Window.partitionBy("region_id").orderBy(F.desc("jaccard"), "parent_id")
    best = both.withColumn("r", F.row_number().over(w)).filter("r = 1").select("region_id", "parent_id", "jaccard")
    out = now.select("region_id").join(best, "region_id", "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    matched = F.col("jaccard") >= least
    return out.select("region_id", F.when(matched, F.col("parent_id")).alias("parent_id"), "jaccard", F.when(matched, "matched").otherwise("born").alias("event"))


def lineage_stats(lines: DataFrame, before: DataFrame) -> DataFrame:
    """n_matched, n_born, n_splits (earlier regions with several heirs), n_died (earlier regions without)."""
    heirs = lines.filter("event = 'matched'").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    died = before.join(heirs, before["region_id"] == heirs["parent_id"], "left_anti").agg(F.count(F.lit(1)).alias("n_died"))
    out = lines.agg(F.sum((F.col("event") == "matched").cast("long")).alias("n_matched"), F.sum((F.col("event") == "born").cast("long")).alias("n_born"))
    splits = heirs.agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_splits"))
    return out.select("*", splits.scalar().alias("n_splits"), died.scalar().alias("n_died"))
