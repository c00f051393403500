"""Structure of nodes in and around their regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators.features import inner_edges, triangles

#: Regions above this size get no betweenness.
BETWEENNESS_MOST = 800


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other"), *more).union(edges.select("v", "u", *more))


def local(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, node): degree inside, weighted degree inside, triangles and clustering in the region's own graph. edges: (u, v, weight)."""
    inner = inner_edges(nodes, edges).join(edges.select("u", "v", "weight"), ["u", "v"])
    degree = inner.select("region_id", F.col("u").alias("node"), "weight").union(inner.select("region_id", "v", "weight")).groupBy("region_id", "node").agg(F.count(F.lit(1)).alias("deg_in"), F.sum("weight").alias("wdeg_in"))
    t = triangles(edges.select("u", "v"))
    of = lambda c: nodes.select("region_id", F.col("node").alias(c))
    t = t.join(of("u"), "u").join(of("v"), ["region_id", "v"]).join(of("w"), ["region_id", "w"])
    corners = t.select("region_id", F.explode(F.array("u", "v", "w")).alias("node")).groupBy("region_id", "node").agg(F.count(F.lit(1)).alias("triangles"))
    out = nodes.join(degree, ["region_id", "node"], "left").join(corners, ["region_id", "node"], "left").na.fill(0)
    return out.withColumn("clustering", F.when(F.col("deg_in") > 1, 2.0 * F.col("triangles") / (F.col("deg_in") * (F.col("deg_in") - 1))).otherwise(0.0))


def boundary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, node): degree, external degree and share, external degree by region size, weight of external edges, other regions
    next door, dual citizenship. edges: (u, v) or (u, v, weight)."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    around = nodes.join(both_ways(weighted, "weight"), "node")
    member = nodes.select("region_id", F.col("node").alias("other"), F.lit(1).alias("inside"))
    deg = around.join(member, ["region_id", "other"], "left").groupBy("region_id", "node").agg(F.count(F.lit(1)).alias("degree"), F.count("inside").alias("deg_in"), F.sum(F.when(F.col("inside").isNull(), F.col("weight"))).alias("bridge_mass"))
    near = around.join(nodes.select(F.col("node").alias("other"), F.col("region_id").alias("r2")), "other").join(member.withColumnRenamed("inside", "own"), ["region_id", "other"], "left").filter("r2 != region_id and own is null")
    near = near.groupBy("region_id", "node").agg(F.countDistinct("r2").alias("n_other_regions"))
    homes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("homes"))
    size = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("size"))
    out = nodes.join(deg, ["region_id", "node"], "left").join(near, ["region_id", "node"], "left").join(homes, "node").join(size, "region_id").na.fill(0)
    ext = F.col("degree") - F.col("deg_in")
    return out.select(
        "region_id", "node", "degree", ext.alias("ext_degree"), F.when(F.col("degree") > 0, ext / F.col("degree")).otherwise(0.0).alias("ext_ratio"), (ext / F.col("size")).alias("ext_deg_norm"),
        F.coalesce("bridge_mass", F.lit(0.0)).alias("bridge_mass"), "n_other_regions", (F.col("homes") > 1).alias("is_dual_citizen"),
    )


def dynamic(nodes: DataFrame, graphs: list[DataFrame]) -> DataFrame:
    """(region_id, node): degree growth over one and two years, share of new edges, mean age and age of the newest edge, turnover, and
    weight inside the region by last year's degree.

    graphs: edges of the origin's year (with weights or without), one and two years before. An edge's age is how many years
    back it goes, at most two; a node without edges has mean age 0 and newest age 2.
    """
    flags = None
    for i, g in enumerate(graphs):
        one = both_ways(g).select("node", "other", *[F.lit(int(i == j)).alias(f"g{j}") for j in range(3)])
        flags = one if flags is None else flags.union(one)
    e = flags.groupBy("node", "other").agg(*[F.max(f"g{j}").alias(f"g{j}") for j in range(3)])
    age = F.when(F.col("g1") == 0, 0).when(F.col("g2") == 0, 1).otherwise(2)
    now = F.col("g0") == 1
    per = e.groupBy("node").agg(
        F.sum("g0").alias("d0"), F.sum("g1").alias("d1"), F.sum("g2").alias("d2"), F.count_if(now & (F.col("g1") == 0)).alias("fresh"), F.count_if(~now & (F.col("g1") == 1)).alias("lost"),
        F.count_if(now | (F.col("g1") == 1)).alias("either"), F.avg(F.when(now, age)).alias("age"), F.min(F.when(now, age)).alias("newest"),
    )
    weighted = graphs[0] if "weight" in graphs[0].columns else graphs[0].withColumn("weight", F.lit(1.0))
    inner = inner_edges(nodes, weighted).join(weighted.select("u", "v", "weight"), ["u", "v"])
    inside = inner.select("region_id", F.col("u").alias("node"), "weight").union(inner.select("region_id", "v", "weight")).groupBy("region_id", "node").agg(F.sum("weight").alias("w"))
    rows = nodes.join(per, "node", "left").join(inside, ["region_id", "node"], "left").na.fill(0, ["d0", "d1", "d2", "fresh", "lost", "either", "w"])
    least = lambda x, c: F.greatest(F.lit(x), c)
    d0, d1, d2 = F.col("d0"), F.col("d1"), F.col("d2")
    return rows.select(
        "region_id", "node", (d0 / least(1, d1)).alias("deg_growth_1y"), (d0 / least(1.0, (d1 + d2) / 2)).alias("deg_growth_2y"), (F.col("fresh") / least(1, d0)).alias("new_edge_share"),
        F.coalesce("age", F.lit(0.0)).alias("edge_mean_age"), F.coalesce("newest", F.lit(2)).cast("double").alias("newest_edge_age"), ((F.col("fresh") + F.col("lost")) / least(1, F.col("either"))).alias("edge_turnover"),
        (F.col("w") / least(1.0, d1.cast("double"))).alias("wdeg_growth"),
    )


def neighbour(nodes: DataFrame, edges: DataFrame, values: DataFrame, births: DataFrame | None = None, origin: int = 0, m: int = 2) -> DataFrame:
    """(region_id, node): means and maxima over the neighbours in the region of papers and velocities, and with ``births`` the share
    that crystallized in the last years as far as confirmed, and the mean age since coinage.

    values: (node, n_t, velocity); births: (concept, coinage_year, crystallization_year).
    """
    inner = inner_edges(nodes, edges)
    near = inner.select("region_id", F.col("u").alias("node"), F.col("v").alias("other")).union(inner.select("region_id", "v", "u")).join(values.select(F.col("node").alias("other"), "n_t", "velocity").distinct(), "other", "left").na.fill(0, ["n_t", "velocity"])
    means = {"nb_mean_velocity": F.avg("velocity"), "nb_max_velocity": F.max("velocity"), "nb_mean_n_t": F.avg("n_t")}
    if births is not None:
        near = near.join(births.select(F.col("concept").alias("other"), "coinage_year", F.col("crystallization_year").alias("cry")), "other", "left")
        recent = F.coalesce(F.col("cry").between(origin - 2, origin - (m - 1)), F.lit(False))
        means |= {"nb_recent_share": F.avg(recent.cast("double")), "nb_mean_coinage_age": F.avg(F.lit(origin) - F.coalesce("coinage_year", F.lit(origin)))}
    per = near.groupBy("region_id", "node").agg(*[c.alias(n) for n, c in means.items()])
    return nodes.join(per, ["region_id", "node"], "left").select("region_id", "node", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in means])


def brokerage(edges: DataFrame) -> DataFrame:
    """node, degree, effective_size, efficiency, burt_constraint, second_degree of an unweighted graph, by joins over edges."""
    both = both_ways(edges)
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    corners = triangles(edges).select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    inverse = degree.select("node", (1.0 / F.col("degree")).alias("p"))
    direct = both.join(inverse, "node").select("node", "other", "p")
    second = both.select("node", F.col("other").alias("mid")).join(inverse, "node").join(direct.select(F.col("node").alias("mid"), "other", F.col("p").alias("q")), "mid").filter("node != other")
    indirect = second.groupBy("node", "other").agg(F.sum(F.col("p") * F.col("q")).alias("via"))
    tie = direct.join(indirect, ["node", "other"], "left").withColumn("c", F.pow(F.col("p") + F.coalesce("via", F.lit(0.0)), F.lit(2)))
    constraint = tie.groupBy("node").agg(F.sum("c").alias("burt_constraint"))
    far = second.select("node", "other").distinct().join(both, ["node", "other"], "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("second_degree"))
    out = degree.join(corners, "node", "left").join(constraint, "node").join(far, "node", "left")
    size = F.col("degree") - 2.0 * F.coalesce("t", F.lit(0)) / F.col("degree")
    return out.select("node", "degree", size.alias("effective_size"), (size / F.col("degree")).alias("efficiency"), "burt_constraint", F.coalesce("second_degree", F.lit(0)).alias("second_degree"))


def centralities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, node, pagerank, coreness, betweenness), each region's own graph in one task; regions are bounded by the guard."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for u, v in zip(frame["u"], frame["v"], strict=True):
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        names = sorted(near)
        rank = dict.fromkeys(names, 1 / len(names))
        for _ in range(100):
            rank = {x: 0.15 / len(names) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in names}
        core, left, k = {}, {x: len(near[x]) for x in names}, 0
        while left:
            x = min(left, key=lambda n: (left[n], n))
            k = max(k, left.pop(x))
            core[x] = k
            for y in near[x] & left.keys():
                left[y] -= 1
        between = dict.fromkeys(names, 0.0)
        for s in names if len(names) <= BETWEENNESS_MOST else ():
            order, far, paths, behind = [s], {s: 0}, dict.fromkeys(names, 0), {x: [] for x in names}
            paths[s] = 1
            for x in order:
                for y in sorted(near[x]):
                    if y not in far:
                        far[y] = far[x] + 1
                        order.append(y)
                    if far[y] == far[x] + 1:
                        paths[y] += paths[x]
                        behind[y].append(x)
            owed = dict.fromkeys(names, 0.0)
            for y in reversed(order[1:]):
                for x in behind[y]:
                    owed[x] += paths[x] / paths[y] * (1 + owed[y])
                between[y] += owed[y] / 2
        return pd.DataFrame({"region_id": frame["region_id"].iloc[0], "node": names, "pagerank": [rank[x] for x in names], "coreness": [core[x] for x in names], "betweenness": [between[x] for x in names]})

    kind = dict(nodes.dtypes)["region_id"]
    return inner_edges(nodes, edges).groupBy("region_id").applyInPandas(run, f"region_id {kind}, node string, pagerank double, coreness int, betweenness double")
