"""Features of regions, pairs of regions, births' profiles and parent sets. Missing is null with a flag, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.config import Config
from chronolex.functions.stats import dot, norm
from chronolex.operators.components import count_groups

# Everywhere: nodes (region_id, node), concepts (paper_id, concept, year, ...), edges (u, v).


def touching(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct (region_id, paper_id, year, quarter) of papers that hold a member."""
    keep = [c for c in ("year", "quarter") if c in concepts.columns]
    return nodes.join(concepts.withColumnRenamed("concept", "node"), "node").select("region_id", "paper_id", *keep).distinct()


def exposure(nodes: DataFrame, concepts: DataFrame, origin: int) -> DataFrame:
    """region_id, n_t, n_t1, n_t2, exposure (of the origin's year) and velocities over one and two years."""
    papers = touching(nodes, concepts.filter(F.col("year").between(origin - 2, origin)))
    count = lambda y: F.sum((F.col("year") == y).cast("long"))
    n = papers.groupBy("region_id").agg(count(origin).alias("n_t"), count(origin - 1).alias("n_t1"), count(origin - 2).alias("n_t2"))
    n = nodes.select("region_id").distinct().join(n, "region_id", "left").na.fill(0)
    one = F.col("n_t") / F.greatest(F.lit(1), F.col("n_t1"))
    two = F.col("n_t") / F.greatest(F.lit(1.0), (F.col("n_t1") + F.col("n_t2")) / 2)
    return n.select("*", F.col("n_t").alias("exposure"), one.alias("paper_velocity_1y"), two.alias("paper_velocity_2y"))


def quarter_acceleration(nodes: DataFrame, concepts: DataFrame, origin: int) -> DataFrame:
    """Mean over quarters of a/max(1,b) - b/max(1,c), this year's against the same quarter of the two before; null without earlier papers."""
    papers = touching(nodes, concepts.filter(F.col("year").between(origin - 2, origin)))
    cell = lambda back, q: F.sum(((F.col("year") == origin - back) & (F.col("quarter") == q)).cast("double"))
    n = papers.groupBy("region_id").agg(*[cell(b, q).alias(f"y{b}q{q}") for b in range(3) for q in range(1, 5)])
    each = [F.col(f"y0q{q}") / F.greatest(F.lit(1.0), F.col(f"y1q{q}")) - F.col(f"y1q{q}") / F.greatest(F.lit(1.0), F.col(f"y2q{q}")) for q in range(1, 5)]
    before = sum((F.col(f"y{b}q{q}") for b in (1, 2) for q in range(1, 5)), F.lit(0.0))
    value = F.when(before > 0, sum(each, F.lit(0.0)) / 4)
    return n.select("region_id", value.alias("yoy_quarter_accel"), value.isNull().alias("yoy_missing"))


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (region_id, u, v) with both ends in the region."""
    a = nodes.select("region_id", F.col("node").alias("u"))
    b = nodes.select("region_id", F.col("node").alias("v"))
    return edges.select("u", "v").join(a, "u").join(b, ["region_id", "v"]).distinct()


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region_id, size, edges_internal, density (null for two nodes or fewer)."""
    size = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("size"))
    inner = inner_edges(nodes, edges).groupBy("region_id").agg(F.count(F.lit(1)).alias("edges_internal"))
    out = size.join(inner, "region_id", "left").withColumn("edges_internal", F.coalesce("edges_internal", F.lit(0)))
    return out.withColumn("density", F.when(F.col("size") > 2, 2.0 * F.col("edges_internal") / (F.col("size") * (F.col("size") - 1))))


def edge_velocity(nodes: DataFrame, edges: DataFrame, before: DataFrame, lines: DataFrame) -> DataFrame:
    """edge_velocity and density_change against the graph a year earlier over the same members; null without a parent."""
    now, then = density(nodes, edges), density(nodes, before).select("region_id", F.col("edges_internal").alias("e1"), F.col("density").alias("d1"))
    parent = lines.filter("event = 'matched'").select("region_id", F.lit(True).alias("has_lineage_parent"))
    out = now.join(then, "region_id").join(parent, "region_id", "left").withColumn("has_lineage_parent", F.coalesce("has_lineage_parent", F.lit(False)))
    own = F.col("has_lineage_parent")
    velocity = F.when(own, F.col("edges_internal") / F.greatest(F.lit(1), F.col("e1")))
    return out.select("region_id", velocity.alias("edge_velocity"), F.when(own, F.col("density") - F.col("d1")).alias("density_change"), (~own).alias("graph_delta_missing"), "has_lineage_parent")


def pace(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, authors: DataFrame, origin: int) -> DataFrame:
    """Medians over a region's linked pairs with joint papers in three years: papers a year, and author groups."""
    recent = concepts.filter(F.col("year").between(origin - 2, origin)).select("paper_id", "year", "concept").distinct()
    pairs = inner_edges(nodes, edges).select("u", "v").distinct()
    joint = pairs.join(recent.withColumnRenamed("concept", "u"), "u").join(recent.select(F.col("concept").alias("v"), "paper_id"), ["v", "paper_id"])
    rate = joint.groupBy("u", "v").agg((F.count(F.lit(1)) / (F.max("year") - F.min("year") + 1)).alias("pace"))
    breadth = count_groups(joint, ["u", "v"], "paper_id", authors, "author")
    per = inner_edges(nodes, edges).join(rate, ["u", "v"]).join(breadth, ["u", "v"])
    out = per.groupBy("region_id").agg(F.median("pace").alias("pace_collaboration"), F.median("n_groups").alias("social_breadth"))
    return nodes.select("region_id").distinct().join(out, "region_id", "left").withColumn("pace_missing", F.col("pace_collaboration").isNull())


def author_influx(papers: DataFrame, authors: DataFrame, unit: str, origin: int, tasks: int | None = None) -> DataFrame:
    """unit, author_influx: share of this year's authors who weren't there in the two years before; null without authors.

    papers: (unit, paper_id, year). tasks: how many share the pairs of units and authors; else as many as a shuffle has.
    """
    seen = papers.filter(F.col("year").between(origin - 2, origin)).join(authors.select("paper_id", "author"), "paper_id")
    if tasks:
        seen = seen.select(unit, "author", "year").repartition(tasks, unit, "author")
    per = seen.groupBy(unit, "author").agg(F.max((F.col("year") == origin).cast("int")).alias("now"), F.max((F.col("year") < origin).cast("int")).alias("past"))
    out = per.groupBy(unit).agg(F.sum("now").alias("n"), F.sum(F.col("now") * (1 - F.col("past"))).alias("new"))
    return out.select(unit, F.when(F.col("n") > 0, F.col("new") / F.col("n")).alias("author_influx"))


def centroid(vectors: DataFrame, unit: str) -> DataFrame:
    """unit, n, center: means by dimension, so a unit of any size is a sum, not a list. vectors: (unit, vec)."""
    parts = vectors.select(unit, F.posexplode("vec").alias("d", "x")).groupBy(unit, "d").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(unit).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("c")).select(unit, "n", F.col("c.x").alias("center"))


def embedding_spread(vectors: DataFrame, unit: str, least: int = 3) -> DataFrame:
    """Mean of 1 - cosine to the centroid, for units with ``least`` vectors."""
    rows = vectors.join(centroid(vectors, unit), unit)
    cosine = dot(F.col("vec"), F.col("center")) / (norm(F.col("vec")) * norm(F.col("center")))
    out = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n_vectors"), F.avg(1 - cosine).alias("s"))
    return out.select(unit, "n_vectors", F.when(F.col("n_vectors") >= least, F.col("s")).alias("embedding_spread"))


def embedding_influx(nodes: DataFrame, before: DataFrame, lines: DataFrame, vectors: DataFrame) -> DataFrame:
    """region_id, embedding_spread, embedding_influx (against the parent's members of a year earlier, by the same vectors), embedding_missing.

    nodes, before: (region_id, node); lines: (region_id, parent_id), null without a parent; vectors: (node, vec).
    """
    of = lambda n: embedding_spread(n.join(vectors, "node").select("region_id", "vec"), "region_id").select("region_id", "embedding_spread")
    past = of(before).select(F.col("region_id").alias("parent_id"), F.col("embedding_spread").alias("s1"))
    out = nodes.select("region_id").distinct().join(of(nodes), "region_id", "left").join(lines.select("region_id", "parent_id"), "region_id", "left").join(past, "parent_id", "left")
    influx = F.col("embedding_spread") - F.col("s1")
    return out.select("region_id", "embedding_spread", influx.alias("embedding_influx"), influx.isNull().alias("embedding_missing"))


def centroid_distances(vectors: DataFrame, unit: str, pairs: DataFrame) -> DataFrame:
    """a, b, centroid_distance for given pairs of units with three vectors or more each."""
    c = centroid(vectors, unit).filter("n >= 3")
    side = lambda name, center: c.select(F.col(unit).alias(name), F.col("center").alias(center))
    rows = pairs.select("a", "b").join(side("a", "ca"), "a").join(side("b", "cb"), "b")
    return rows.select("a", "b", (1 - dot(F.col("ca"), F.col("cb")) / (norm(F.col("ca")) * norm(F.col("cb")))).alias("centroid_distance"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a < b, bridge_mass: distinct edges that run between two regions. By edges, never by pairs of regions."""
    x = edges.join(nodes.select(F.col("node").alias("u"), F.col("region_id").alias("ra")), "u").join(nodes.select(F.col("node").alias("v"), F.col("region_id").alias("rb")), "v").filter("ra != rb")
    return x.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "u", "v").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("bridge_mass"))


def pair_features(nodes: DataFrame, edges: DataFrame, before: DataFrame, concepts: DataFrame, vectors: DataFrame, origin: int) -> DataFrame:
    """Of pairs of regions with a bridge: sizes, bridge mass now and over last year's edges, growth, dual members and papers, distance.

    Membership is that of the origin on both sides; growth is null, and flagged, where last year has no bridge. vectors: (node, vec).
    """
    now = bridges(nodes, edges)
    past = bridges(nodes, before).withColumnRenamed("bridge_mass", "bridge_mass_prev")
    size = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    of = lambda name: size.select(F.col("region_id").alias(name), F.col("n").alias(f"size_{name}"))
    far = centroid_distances(nodes.join(vectors, "node").select("region_id", "vec"), "region_id", now)
    out = now.join(past, ["a", "b"], "left").join(of("a"), "a").join(of("b"), "b").join(dual_papers(nodes, now, concepts, origin), ["a", "b"]).join(far, ["a", "b"], "left")
    growth = F.col("bridge_mass") / F.greatest(F.lit(1), F.col("bridge_mass_prev"))
    return out.select(
        "a", "b", "size_a", "size_b", "bridge_mass", "bridge_mass_prev", F.when(F.col("bridge_mass_prev").isNotNull(), growth).alias("bridge_growth"), F.col("bridge_mass_prev").isNull().alias("bridge_growth_missing"),
        "dual_citizens", "dual_papers", "centroid_distance", F.col("centroid_distance").isNull().alias("centroid_distance_missing"),
    )


def dual_papers(nodes: DataFrame, pairs: DataFrame, concepts: DataFrame, origin: int) -> DataFrame:
    """a, b, dual_citizens (shared members), dual_papers (papers of three years that touch both), for given pairs of regions."""
    papers = touching(nodes, concepts.filter(F.col("year").between(origin - 2, origin))).select("region_id", "paper_id").distinct()
    of = lambda rows, name, item: rows.select(F.col("region_id").alias(name), item)
    both = pairs.select("a", "b").join(of(papers, "a", "paper_id"), "a").join(of(papers, "b", "paper_id"), ["b", "paper_id"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("dual_papers"))
    dual = pairs.select("a", "b").join(of(nodes, "a", "node"), "a").join(of(nodes, "b", "node"), ["b", "node"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("dual_citizens"))
    return pairs.select("a", "b").join(dual, ["a", "b"], "left").join(both, ["a", "b"], "left").na.fill(0, ["dual_citizens", "dual_papers"])


def profiles(concepts: DataFrame, births: DataFrame, cfg: Config) -> DataFrame:
    """(concept, member, n, lift, rank): what stands in a birth's first papers more often than elsewhere.

    A paper counts once, however many member terms it has; ties of lift go by name. births: (concept).
    """
    own = concepts.select("concept", "paper_id", "v1_date").distinct()
    w = Window.partitionBy("concept").orderBy("v1_date", "paper_id")
    first = own.join(births.select("concept"), "concept", "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cfg.profile_papers)
    n_first = first.groupBy("concept").agg(F.count(F.lit(1)).alias("n_papers"), F.max("v1_date").alias("max_date"))
    df = own.groupBy("concept").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("concept", "member")
    total = own.agg(F.countDistinct("paper_id").alias("total"))
    with_ = first.join(own.select(F.col("concept").alias("member"), "paper_id"), "paper_id").filter("concept != member")
    counts = with_.groupBy("concept", "member").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cfg.profile_min_count)
    rows = counts.join(n_first, "concept").join(df, "member").withColumn("total", total.scalar())
    lift = (F.col("n") / F.col("n_papers")) / F.greatest(F.lit(1e-9), F.col("df") / F.col("total"))
    rows = rows.withColumn("lift", lift)
    by_lift = Window.partitionBy("concept").orderBy(F.desc(F.round("lift", 9)), "member")
    return rows.withColumn("rank", F.row_number().over(by_lift)).filter(F.col("rank") <= cfg.profile_top).select("concept", "member", "n", "lift", "rank", "max_date")


def admissible(profile: DataFrame, cry: DataFrame, origin: int, m: int) -> DataFrame:
    """The profiles of births that are confirmed at the origin and whose first papers all lie before its end."""
    known = cry.filter(F.col("crystallization_year") <= origin - (m - 1)).select("concept")
    return profile.filter(F.year("max_date") <= origin).join(known, "concept", "left_semi")


def subprofiles(profile: DataFrame, least: int = 3) -> DataFrame:
    """members (two or three, sorted), support: sets that stand in the profiles of ``least`` births."""
    a = profile.select("concept", F.col("member").alias("x"))
    two = a.join(a.withColumnRenamed("x", "y"), "concept").filter("x < y")
    three = two.join(a.withColumnRenamed("x", "z"), "concept").filter("y < z")
    every = two.select(F.array("x", "y").alias("members")).union(three.select(F.array("x", "y", "z")))
    return every.groupBy("members").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)


def parent_sets(sets: DataFrame, found: DataFrame, every: DataFrame, most: int = 1500) -> DataFrame:
    """unit_id, members, generator, support: the best of both generators, each cut on its own, half of ``most`` from the first.

    sets: (members, support) with the least support; found: (u, v, w) triangles, already the best; every: (members, support)
    without a floor, so that a triangle that only one birth grew out of has its support. Ties of support go by name.
    """
    top = sets.orderBy(F.desc("support"), F.array_join("members", "\u0001")).limit(most // 2).select("members", F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = top.union(found.select(F.array("u", "v", "w"), F.lit(0), F.lit(1))).groupBy("members").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    kind = F.when(F.col("b") == 0, "sub_profile").when(F.col("a") == 0, "triangle").otherwise("both")
    rows = both.join(every, "members", "left").select("members", kind.alias("generator"), F.coalesce("support", F.lit(0)).alias("support"))
    return rows.select(F.array_join("members", " + ").alias("unit_id"), "members", "generator", "support")


def triangles(edges: DataFrame) -> DataFrame:
    b, c = edges.select(F.col("u").alias("v"), F.col("v").alias("w")), edges.select("u", F.col("v").alias("w"))
    return edges.select("u", "v").join(b, "v").join(c, ["u", "w"]).select("u", "v", "w")


def triangle_pace(edges: DataFrame, concepts: DataFrame, origin: int, most: int = 500) -> DataFrame:
    """u, v, w, score: triangles by the least joint papers a year of their sides in three years; the best ``most``."""
    recent = concepts.filter(F.col("year").between(origin - 2, origin)).select("paper_id", "concept").distinct()
    joint = edges.join(recent.withColumnRenamed("concept", "u"), "u").join(recent.withColumnRenamed("concept", "v"), ["v", "paper_id"]).groupBy("u", "v").agg((F.count(F.lit(1)) / 3.0).alias("p"))
    side = lambda x, y, name: joint.select(F.col("u").alias(x), F.col("v").alias(y), F.col("p").alias(name))
    rows = triangles(edges).join(side("u", "v", "p1"), ["u", "v"]).join(side("v", "w", "p2"), ["v", "w"]).join(side("u", "w", "p3"), ["u", "w"])
    rows = rows.select("u", "v", "w", F.least("p1", "p2", "p3").alias("score")).filter("score > 0")
    return rows.orderBy(F.desc("score"), "u", "v", "w").limit(most)


def unit_features(sets: DataFrame, concepts: DataFrame, authors: DataFrame, origin: int, vectors: DataFrame | None = None) -> DataFrame:
    """Of parent sets (unit_id, members): exposures, velocities, acceleration, joint papers and share, whether members have met, pace,
    influx and spread. Sets without a paper in the origin's year are left out. vectors: (node, vec)."""
    nodes = sets.select(F.col("unit_id").alias("region_id"), F.explode("members").alias("node"))
    out = exposure(nodes, concepts, origin).filter("n_t > 0")
    window = concepts.filter(F.col("year").between(origin - 4, origin)).select("paper_id", "year", F.col("concept").alias("node")).distinct()
    need = sets.select(F.col("unit_id").alias("region_id"), F.least(F.lit(2), F.size("members")).alias("need"))
    hits = nodes.join(window, "node").groupBy("region_id", "paper_id", "year").agg(F.count(F.lit(1)).alias("n")).join(need, "region_id")
    met = F.col("n") >= F.col("need")
    joint = hits.groupBy("region_id").agg(F.count_if(met & (F.col("year") == origin)).alias("joint_papers_t"), F.count_if(met).alias("joint_papers_window"), (F.count(F.lit(1)) / 3.0).alias("pace"))
    accel = quarter_acceleration(nodes, concepts, origin).select("region_id", "yoy_quarter_accel") if "quarter" in concepts.columns else None
    out = out.join(joint, "region_id", "left").join(author_influx(touching(nodes, concepts), authors, "region_id", origin), "region_id", "left")
    if accel is not None:
        out = out.join(accel, "region_id", "left")
    if vectors is not None:
        spread = embedding_spread(nodes.join(vectors, "node").select("region_id", "vec"), "region_id", 2).select("region_id", "embedding_spread")
        out = out.join(spread, "region_id", "left").withColumn("embedding_missing", F.col("embedding_spread").isNull())
    return out.select("*", (F.col("joint_papers_t") / F.col("n_t")).alias("joint_share"), (F.col("joint_papers_window") > 0).alias("members_have_met")).withColumnRenamed("region_id", "unit_id")
