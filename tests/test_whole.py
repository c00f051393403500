"""Queries read whole tables and texts: small tables written to disk, against brute force."""

from __future__ import annotations

import datetime as dt
import inspect
from collections import Counter

import pytest

from chronolex.operators import evaluate, features, models
from chronolex.operators.components import union_find
from chronolex.plans import baskets, catalog


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()]


def test_strip_markup_reads_whole_texts(spark, tmp_path):
    far = "word " * 60
    texts = [far + r"\emph{late} $y$ end", r"a \begin{eq}" + far + r"\end{eq} b", "short", None]
    found = dict(run(spark, tmp_path, "strip_markup", documents=(list(enumerate(texts)), "doc_id long, text string")))
    assert found == {0: "deep net " + far + "late end", 1: "deep net a b", 2: "deep net short", 3: None}


LINES = [(order, supplier, number, quantity) for order, supplier, number, quantity in zip((1, 1, 2, 2, 3, 4, 51, 51), (7, 8, 8, 9, 5, 5, 6, 6), (1, 4, 2, 3, 7, 5, 6, 3), (50.0, 1.0, 2.0, 50.0, 3.0, 50.0, 4.0, 5.0))]
LINEITEM = (LINES, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double")


def test_union_components_of_all_rows(spark, tmp_path):
    found = dict(run(spark, tmp_path, "union_components", lineitem=LINEITEM))
    assert found == union_find((str(o), f"s{s}") for o, s, _, _ in LINES) and len(found) == 10


def test_judge_ingest_of_all_rows(spark, tmp_path):
    verdict = lambda n: ("KEEP", "DROP", None)[n % 3]
    expected = Counter((o % 50, n % 3 == 2, verdict(n)) for o, _, n, _ in LINES)
    assert {r[:3]: r[3] for r in run(spark, tmp_path, "judge_ingest", lineitem=LINEITEM)} == expected


def grams(text, sizes=(1, 2, 3)):
    w = text.split()
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


TEXTS = [f"common pair {chr(97 + i)}word" if i < 9 else "rare pair" for i in range(11)] + ["alone"]
DOCUMENTS = (list(enumerate(TEXTS)), "doc_id long, text string")
ORDERS = ([(1,)], "o_orderkey long")


def test_ledgers_have_every_candidate(spark, tmp_path):
    df = Counter(g for t in TEXTS for g in grams(t, (2, 3)))
    found = run(spark, tmp_path, "ngram_ledger", documents=DOCUMENTS, orders=ORDERS)
    assert {(r[0], r[1], r[4]) for r in found} == {(g, n, len(g.split())) for g, n in df.items()} and len(found) == len(df)
    df += Counter(g for t in TEXTS for g in grams(t, (1,)) if g not in ("common", "rare"))  # all words are nouns: ends of chunks are nominated
    found = run(spark, tmp_path, "ledger", documents=DOCUMENTS, orders=ORDERS)
    assert {(r[0], r[1]) for r in found} == set(df.items()) and len(found) == len(df)
    yearly = run(spark, tmp_path, "ledger_yearly", documents=DOCUMENTS, orders=ORDERS)
    assert {(c, y): n for c, y, n in yearly} == {(g, 2016): n for g, n in df.items()}


def test_term_postings_take_the_configured_floor(spark, tmp_path):
    df = Counter(g for t in TEXTS for g in grams(t))
    expected = Counter((i, g) for i, t in enumerate(TEXTS) for g in grams(t) if df[g] >= 9)
    assert Counter(run(spark, tmp_path, "term_postings", documents=DOCUMENTS, orders=ORDERS)) == expected and expected


def test_string_variants_of_the_data(spark, tmp_path):
    texts = ["colour"] * 9 + ["color"] * 10 + ["pre-train"] * 12 + ["pretrain"] * 9 + ["honour"] * 8 + ["honor"] * 20
    found = run(spark, tmp_path, "string_variants", documents=(list(enumerate(texts)), "doc_id long, text string"), orders=ORDERS)
    assert sorted(found) == [("colour", "color"), ("pretrain", "pre-train")]


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "operator", "expected"),
    [("word2vec_spread", models, "embed", {"dim": 200, "epochs": 5, "window": 5}), ("gbt_rank", models, "boosted_scores", {"rounds": 300, "step": 0.03}), ("bootstrap_ci", evaluate, "bootstrap", {"n": 2000})],
)
def test_queries_run_at_full_settings(spark, monkeypatch, name, module, operator, expected):
    signature = inspect.signature(getattr(module, operator))

    def record(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in expected})

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as call:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert call.value.args[0] == expected


STAR = {
    "orders": ([(o, dt.datetime(1997, 1 + o % 12, 1), o % 7) for o in range(100)], "o_orderkey long, o_orderdate timestamp, o_custkey long"),
    "part": ([(p, f"{'red' if p % 2 else 'blue'} ring", ("ECONOMY", "SMALL")[p % 2]) for p in range(6)], "p_partkey long, p_name string, p_type string"),
    "lineitem": ([(o, (o * 5 + i) % 6, (o + i) % 4) for o in range(100) for i in range(3)], "l_orderkey long, l_partkey long, l_suppkey long"),
}


def test_events_of_few_papers_a_task(spark, tmp_path, monkeypatch):
    for table, (rows, schema) in STAR.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(baskets, "TASK_PAPERS", 5)
    b = baskets.Baskets(spark, str(tmp_path))
    assert b.tasks == 20 and b.events.rdd.getNumPartitions() == 20
    terms = lambda p: {f"{'red' if p % 2 else 'blue'} ring", f"{'red ring small' if p % 2 else 'blue ring economy'}", "ring"}
    expected = {(o, t) for o, p, _ in STAR["lineitem"][0] for t in terms(p)}
    found = [(r.paper_id, r.term) for r in b.events.collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert "/chronolex-" in b.merge_map.inputFiles()[0]  # written: its size is known, so that papers are not gathered by term


def test_k_sweep_without_births_has_a_row_for_each_k(spark, tmp_path):
    assert sorted(run(spark, tmp_path, "k_sweep", **STAR)) == [(k, None, None, None) for k in (1, 5, 10, 20)]


def test_author_influx_is_shared_by_tasks(spark):
    papers = spark.createDataFrame([("u", 1, 2000), ("u", 2, 1999), ("v", 1, 2000)], "unit string, paper_id int, year int")
    authors = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "paper_id int, author string")
    out = features.author_influx(papers, authors, "unit", 2000, 7)
    assert {r.unit: r.author_influx for r in out.collect()} == {"u": 0.5, "v": 1.0}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
