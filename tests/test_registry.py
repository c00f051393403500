"""Registry windows, decline, fate, censoring and author groups on hand fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest

from chronolex.config import Config
from chronolex.governance import LeakageError, assert_causal, log_event, sha256_obj
from chronolex.operators import components, registry
from chronolex.operators.components import count_groups, label_components, union_find

CFG = Config(k_year=5, m=2, last_complete_year=2025)
SERIES = {
    "x": {2019: 5, 2020: 6, 2021: 1, 2022: 2},
    "y": {2025: 7},
    "z": {2018: 10, 2020: 10},
    "w": {2024: 5, 2025: 5},
    "u": {2019: 5, 2020: 5, 2024: 4},
    "s": {2022: 6, 2023: 6, 2025: 3},
    "r": {2023: 9, 2024: 9, 2025: 1},
    "v": {2017: 10, 2018: 10, 2025: 9},
}
EXPECTED = {
    "x": (2019, 2021, "crystallized_then_declined"),
    "y": (None, None, "censored"),
    "z": (None, None, "coinage_only"),
    "w": (2024, None, "persisted"),
    "u": (2019, 2021, "crystallized_then_declined"),
    "s": (2022, 2024, "crystallized_then_declined"),
    "r": (2023, None, "persisted"),
    "v": (None, None, "coinage_only"),
}


def test_fates(spark):
    counts = spark.createDataFrame([(c, y, n) for c, s in SERIES.items() for y, n in s.items()], "concept string, year int, n_papers long")
    windows = registry.frequency_windows(counts, CFG)
    groups = spark.createDataFrame([(r.concept, r.t, 1 if r.concept == "v" else 3) for r in windows.collect()], "concept string, t int, n_groups int")
    cry = registry.crystallizations(windows, groups, CFG)
    members = counts.selectExpr("concept", "make_date(year, 1, 1) AS first_date")
    found = {r.concept: (r.crystallization_year, r.decline_year, r.fate) for r in registry.registry(counts, windows, cry, members, CFG).collect()}
    assert found == EXPECTED


def test_author_groups(spark):
    rows = [("c", 1, "p1", "a"), ("c", 1, "p1", "b"), ("c", 1, "p2", "b"), ("c", 1, "p2", "c"), ("c", 1, "p3", "d"), ("c", 1, "p4", None), ("d", 1, "p1", "a"), ("d", 1, "p2", "a")]
    frame = spark.createDataFrame(rows, "concept string, t int, paper_id string, author string")
    found = count_groups(frame, ["concept", "t"], "paper_id", frame.filter("concept = 'c'"), "author")
    assert {r.concept: r.n_groups for r in found.collect()} == {"c": 3, "d": 1}
    alone = spark.createDataFrame([("p1", "a"), ("p3", "a"), ("p4", None)], "paper_id string, author string")
    assert {r.concept: r.n_groups for r in count_groups(frame, ["concept"], "paper_id", alone, "author").collect()} == {"c": 3, "d": 2}


@pytest.mark.parametrize("most", [0, 8, 200_000])
def test_author_groups_against_union_find(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(5)
    items = [(f"g{rng.randrange(6)}", p) for p in range(80) for _ in range(2)]
    links = [(p, f"a{rng.randrange(60)}") for p in range(80) for _ in range(rng.randrange(4))]
    found = {r.g: r.n_groups for r in count_groups(spark.createDataFrame(items, "g string, p int"), ["g"], "p", spark.createDataFrame(links, "p int, a string"), "a").collect()}
    expected = {}
    for g in {g for g, _ in items}:
        own = {p for x, p in items if x == g}
        pairs = [(f"p{p}", f"p{p}") for p in own] + [(f"p{p}", a) for p, a in links if p in own]
        expected[g] = len(set(union_find(pairs).values()))
    assert found == expected


def test_components_of_a_long_path(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("a", "b")]
    found = {r.node: r.root for r in label_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == union_find(edges)


def test_asof_rules(spark):
    events = spark.createDataFrame([("p", "peft", dt.date(2023, 5, 1), 2023), ("q", "peft", dt.date(2023, 8, 1), 2023)], "paper_id string, term string, v1_date date, year int")
    merged = spark.createDataFrame([("peft", "fine-tuning", dt.date(2023, 7, 11))], "cand string, cluster string, effective_date date")
    of = lambda *rule: [r.concept for r in registry.concepts_of(events, merged, *rule).orderBy("paper_id").collect()]
    assert of("origin", 2022) == ["peft", "peft"]
    assert of("origin", 2023) == of("year") == ["fine-tuning", "fine-tuning"]
    assert of("day") == ["peft", "fine-tuning"]


def test_causality():
    day = dt.date(2020, 12, 31)
    assert_causal("a", day, day)
    assert_causal("a", day, None)
    with pytest.raises(LeakageError):
        assert_causal("a", day, dt.date(2021, 1, 1))


def test_event_log(tmp_path):
    path = tmp_path / "log.jsonl"
    a, b = log_event(str(path), {"what": "merge"}), log_event(str(path), {"what": "merge", "undone": True})
    assert a != b and len(path.read_text().splitlines()) == 2
    assert sha256_obj({"a": 1, "b": 2}) == sha256_obj({"b": 2, "a": 1})


@pytest.mark.parametrize("most", [0, 5, 1_000_000])
def test_groups_of_parts_are_folded_in_order(spark, monkeypatch, most):
    rng = random.Random(9)
    links = {p: {f"a{rng.randrange(40)}" for _ in range(p % 4)} for p in range(60)}
    items = [(f"g{rng.randrange(4)}", rng.randrange(3), p) for p in range(60) for _ in range(3)]
    within = [(f"g{g}", y, t) for g in range(4) for t in range(2) for y in (t, t + 1)]
    rows = spark.createDataFrame([(p, a) for p, own in links.items() for a in own], "p int, a string")
    found = count_groups(spark.createDataFrame(items, "g string, y int, p int"), ["g", "t"], "p", rows, "a", spark.createDataFrame(within, "g string, y int, t int"))
    expected = {}
    for g, t in {(g, t) for g, _, t in within}:
        own = {p for x, y, p in items if x == g and y in (t, t + 1)}
        expected[g, t] = len(set(union_find([e for p in own for e in [(f"p{p}", f"p{p}"), *((f"p{p}", a) for a in links[p])]]).values()))
    assert {(r.g, r.t): r.n_groups for r in found.collect()} == expected

    monkeypatch.setattr(components, "TASK_EDGES", most)
    ids = lambda x: [int(a[1:]) for a in sorted(links[x])] or None
    order = sorted((f"{g} {t}", p) for g, t in expected for p in {p for x, y, p in items if x == g and y in (t, t + 1)})
    names = sorted({k for k, _ in order})
    batches = [pa.RecordBatch.from_pydict({"_group": [names.index(k) for k, _ in order[i : i + 7]], "_ids": pa.array([ids(p) for _, p in order[i : i + 7]], pa.list_(pa.int64())), "_alone": [None if ids(p) else str(p) for _, p in order[i : i + 7]]}) for i in range(0, len(order), 7)]
    counted = [(names[g], n) for b in components._folded(batches) for g, n in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(counted) == sorted((f"{g} {t}", n) for (g, t), n in expected.items())


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_components_from_trees(spark, monkeypatch, most):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)] + [("é", "z"), ("ab", "b")]
    monkeypatch.setattr(components, "TASK_EDGES", most)
    steps = []
    monkeypatch.setattr(components, "_labels_by_steps", lambda e, n=None, run=components._labels_by_steps: steps.append(e.count()) or run(e, n))
    nodes = spark.createDataFrame([("lone",), ("é",)], "node string")
    found = {r.node: r.root for r in label_components(spark.createDataFrame(edges, "a string, b string").coalesce(1), nodes).collect()}
    assert found == union_find(edges) | {"lone": "lone"}
    assert steps[0] < len({n for e in edges for n in e}) / 2  # only roots of trees that share a node are followed
