"""Projection, cliques, regions, lineage, attachment and ranking on hand fixtures."""

from __future__ import annotations

from itertools import combinations
from random import Random

import pytest

from chronolex.config import Config
from chronolex.functions.stats import hypergeom_tail
from chronolex.operators import attach, evaluate, features, graph, structure
from chronolex.operators.components import union_find

CFG = Config(graph_window=1)


def papers(spark, table):
    return spark.createDataFrame([(p, c, 2000) for p, cs in table.items() for c in cs], "paper_id string, concept string, year int")


def test_projection(spark):
    edges = graph.project(papers(spark, {"p1": "ab", "p2": "abc", "p3": "c"}), 2000, CFG).collect()
    found = {(e.u, e.v): (round(e.weight, 6), e.n_papers, round(e.lift, 6)) for e in edges}
    assert found == {("a", "b"): (1.333333, 2, 1.5), ("a", "c"): (0.333333, 1, 0.75), ("b", "c"): (0.333333, 1, 0.75)}


def test_contained_names_make_no_edge(spark):
    rows = papers(spark, {"p4": ["detection", "object detection", "yolo"], "p5": ["net", "neural net"], "p6": ["net", "network"]})
    edges = {(e.u, e.v): round(e.weight, 6) for e in graph.project(rows, 2000, CFG).collect()}
    assert edges == {("detection", "yolo"): 0.5, ("object detection", "yolo"): 0.5, ("net", "network"): 1.0}
    assert graph.mass(rows, 2000, CFG).first().asDict() == {"total_weight": 2.0, "n_papers": 2}


def test_cap_keeps_the_rarest(spark):
    table = {"p": "abcd"} | {f"q{i}": "a" for i in range(8)} | {f"r{i}": "b" for i in range(2)} | {f"s{i}": "c" for i in range(2)}
    kept = graph.capped(papers(spark, table).select("paper_id", "concept"), CFG.with_(cap=2)).filter("paper_id = 'p'")
    assert {r.concept for r in kept.collect()} == {"b", "d"}


def regions_of(spark, edges, k):
    return {tuple(r.members) for r in graph.regions(spark.createDataFrame(edges, "u string, v string"), k).collect()}


def test_percolation(spark):
    edges = [(a, b) for a, b in combinations("1234", 2)] + [("3", "5"), ("4", "5"), ("5", "6"), ("6", "7"), ("6", "8"), ("7", "8")]
    assert regions_of(spark, edges, 3) == {("1", "2", "3", "4", "5"), ("6", "7", "8")}
    assert regions_of(spark, edges, 4) == {("1", "2", "3", "4")}
    assert regions_of(spark, edges, 5) == set()
    assert regions_of(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "e")], 3) == {("a", "b", "c"), ("c", "d", "e")}


def test_percolation_against_brute_force(spark):
    random = Random(3)
    names = [f"n{i:02d}" for i in range(12)]
    edges = [e for e in combinations(names, 2) if random.random() < 0.4]
    has = set(edges)
    cliques = [c for c in combinations(names, 3) if all(e in has for e in combinations(c, 2))]
    roots = union_find([(a, b) for a in cliques for b in cliques if len(set(a) & set(b)) >= 2])
    expected = {tuple(sorted({n for c, r in roots.items() if r == root for n in c})) for root in set(roots.values())}
    assert regions_of(spark, edges, 3) == expected


def test_lineage(spark):
    before = spark.createDataFrame([("old", list("abcd"))], "region_id string, members array<string>")
    now = spark.createDataFrame([("n1", list("bcde")), ("n2", list("xyza")), ("n3", list("q"))], "region_id string, members array<string>")
    lines = graph.lineage(now, before, 0.3)
    assert {r.region_id: (r.parent_id, round(r.jaccard, 3), r.event) for r in lines.collect()} == {"n1": ("old", 0.6, "matched"), "n2": (None, 0.143, "born"), "n3": (None, 0.0, "born")}
    assert graph.lineage_stats(lines, before).first().asDict() == {"n_matched": 1, "n_born": 2, "n_splits": 0, "n_died": 0}


@pytest.mark.parametrize(("o", "v", "r", "p", "expected"), [(2, 100000, 12, 10, 5.9369e-07), (3, 106000, 900, 10, 7.0020e-05), (2, 106000, 900, 10, 3.0973e-03), (1, 106000, 900, 10, 8.1737e-02)])
def test_hypergeometric_tail(spark, o, v, r, p, expected):
    from pyspark.sql import functions as F

    row = spark.range(1).select(hypergeom_tail(*[F.lit(x) for x in (o, v, r, p)]).alias("p")).first()
    assert row.p == pytest.approx(expected, rel=1e-4)


def test_attachment(spark):
    births = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "concept string")
    profile = spark.createDataFrame([("b1", m) for m in "abcd"] + [("b2", "z")], "concept string, member string")
    nodes = spark.createDataFrame([("r1", m) for m in "abcx"] + [("r2", m) for m in "abcd"], "region_id string, node string")
    population = spark.createDataFrame([(20,)], "v int")
    rows = {(r.concept, r.unit_id): (r.overlap, r.mass, r.orphan) for r in attach.attach(births, profile, nodes, population, CFG).collect()}
    assert rows == {("b1", "r1"): (3, 0.5, False), ("b1", "r2"): (4, 0.5, False), ("b2", None): (0, 0.0, True)}


def test_ranking(spark):
    scored = spark.createDataFrame([("r", "A", 0.9), ("r", "B", 0.8), ("r", "C", 0.8), ("r", "D", 0.1), ("s", "A", 1.0)], "region_id string, node string, score double")
    truth = spark.createDataFrame([("r", "birth", "B"), ("r", "birth", "D"), ("s", "birth", "A")], "region_id string, concept string, node string")
    (row,) = evaluate.scores(evaluate.ranked(scored), truth, 2).collect()
    assert (row.region_id, row.recall_at_k, row.hit_rate, row.mean_true_rank, row.norm_rank, row.avg_precision) == ("r", 0.5, 1.0, 3.0, 0.75, 0.5)


def test_quarter_acceleration(spark):
    counts = {2000: (4, 2, 0, 1), 1999: (2, 2, 1, 0), 1998: (1, 0, 0, 0)}
    rows = [(f"{y}{q}{i}", "n", y, q + 1) for y, qs in counts.items() for q, n in enumerate(qs) for i in range(n)]
    concepts = spark.createDataFrame(rows, "paper_id string, concept string, year int, quarter int")
    nodes = spark.createDataFrame([("r", "n")], "region_id string, node string")
    assert features.quarter_acceleration(nodes, concepts, 2000).first().yoy_quarter_accel == pytest.approx(-0.25)


def test_centralities_of_a_star(spark):
    nodes = spark.createDataFrame([("r", x) for x in "abcd"], "region_id string, node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "u string, v string")
    found = {r.node: r for r in structure.centralities(nodes, edges).collect()}
    assert found["a"].betweenness == 3.0 and found["b"].betweenness == 0.0
    assert {r.coreness for r in found.values()} == {1}
    assert sum(r.pagerank for r in found.values()) == pytest.approx(1.0)
