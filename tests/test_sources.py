"""Scans, sinks, artifacts, manifests, gates, configuration and the yearly run, on small files."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronolex import governance, schemas
from chronolex.config import Config, load_config
from chronolex.operators import models
from chronolex.operators.corpus import papers
from chronolex.plans import origins
from chronolex.plans.baskets import Baskets
from chronolex.sources import tables

DATA = "/root/testdata/sf0.001"


def test_records_from_a_zip(spark, tmp_path):
    rows = [{"id": f"{i}", "title": "t", "abstract": f"text {i}", "categories": "cs.CL", "created": "Mon, 2 Apr 2007 19:18:42 GMT", "authors": ["A B"], "n_versions": 1} for i in range(5)]
    lines = "\n".join([*map(json.dumps, rows), "broken {", json.dumps(rows[0])])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("r.jsonl", lines)
    path = tables.unzip_member(spark, str(tmp_path / "a.zip"), "r.jsonl", str(tmp_path / "out"))
    records = tables.read_records(spark, path)
    assert records.count() == 7 and records.filter("id is null").count() == 1
    kept = papers(records, ["cs.CL"], "2020-01-01").collect()
    assert sorted(r.id for r in kept) == [str(i) for i in range(5)] and kept[0].v1_date == dt.date(2007, 4, 2)


def test_verdict_files(spark, tmp_path):
    (tmp_path / "batch_0007.txt").write_text("1\tKEEP\n2: drop\n")
    (tmp_path / "index.jsonl").write_text('{"batch": 7, "line": 1, "term": "a"}\n')
    assert sorted(tuple(r) for r in tables.read_verdict_lines(spark, str(tmp_path / "batch_*.txt")).collect()) == [(7, "1\tKEEP"), (7, "2: drop")]
    assert [tuple(r) for r in tables.read_verdict_index(spark, str(tmp_path / "index.jsonl")).collect()] == [(7, 1, "a")]


def test_artifacts_are_built_once_and_conform(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("c", 3, 1999, "x")], "concept string, n_papers long, year long, other string")

    for _ in range(2):
        found = tables.artifact(spark, str(tmp_path / "series"), build, schema=schemas.CONCEPT_YEAR)
        assert found.dtypes == [("concept", "string"), ("year", "smallint"), ("n_papers", "int")] and found.collect() == [("c", 1999, 3)]
    assert built == [1] and any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "series").iterdir())
    tables.artifact(spark, str(tmp_path / "parts"), lambda: spark.range(4).withColumn("origin", F.col("id") % 2), "origin")
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"origin=0", "origin=1"}
    with pytest.raises(Exception, match="n_papers"):
        tables.conform(spark.createDataFrame([("c", 1)], "concept string, year int"), schemas.CONCEPT_YEAR)


def test_manifest_and_gates(spark):
    rows = spark.createDataFrame([(1, dt.date(2000, 5, 1)), (2, dt.date(2000, 6, 1))], "id int, day date")
    entry = governance.manifest("a", dt.date(2000, 12, 31), rows, "day", {"x": 1}, {"rows": rows})
    assert (entry["rows"], entry["max_observed_date"], entry["inputs"]["rows"]["checksum"]) == (2, "2000-06-01", entry["checksum"])
    assert governance.checksum(rows.repartition(3)) == governance.checksum(rows)
    with pytest.raises(governance.LeakageError):
        governance.manifest("a", dt.date(2000, 5, 31), rows, "day", {}, {})
    assert governance.out_of_band("kept", 5, (1, 10), "1") is None and governance.out_of_band("kept", 11, (1, 10), "1")["kind"] == "out_of_band"
    with pytest.raises(governance.GateClosed):
        governance.require_signed_off({"features": False}, "features")
    governance.require_signed_off({"features": True}, "features")


def test_config_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("k_year: 9\nm: 3\n")
    assert load_config(str(tmp_path / "c.yaml")) == Config(k_year=9, m=3)


def test_yearly_run_continues(spark, tmp_path):
    rows = [(f"{y}{g}{i}", f"{g}{n}", y, 1 + i % 4, dt.date(y, 3 * (i % 4) + 1, 1)) for y in range(1996, 2001) for g in "ab" for i in range(4) for n in range(4)]
    concepts = spark.createDataFrame(rows, "paper_id string, concept string, year int, quarter int, v1_date date")
    authors = concepts.select("paper_id", F.substring("paper_id", 5, 1).alias("author")).distinct()
    made = origins.Origins(concepts, authors, str(tmp_path), Config(binarize_papers=2, binarize_lift=1.0, max_region_share=0.6))
    found = [tuple(r) for r in made.run(1998, 2000, [3]).collect()]
    assert found == [(1999, 3, 2, 2, 2), (2000, 3, 2, 2, 2)]
    assert made.features(2000, 3).filter("edges_internal = 6 and n_t = 4 and graph_delta_missing = false").count() == 2
    assert json.loads((tmp_path / "edges_2000.manifest.json").read_text())["max_observed_date"] == "2000-10-01"
    first = (tmp_path / "regions/k=3/origin=1999/_SUCCESS").stat().st_mtime_ns
    assert [tuple(r) for r in made.run(1998, 2000, [3]).collect()] == found and (tmp_path / "regions/k=3/origin=1999/_SUCCESS").stat().st_mtime_ns == first
    vectors = made.embeddings(2000, dim=8, epochs=1)
    assert vectors.count() == 8 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-5 for r in vectors.collect())


def test_text_artifacts(spark, tmp_path):
    made = origins.text_artifacts(Baskets(spark, DATA), str(tmp_path))
    assert made["ledger"].agg(F.sum("df")).first()[0] == made["ledger_yearly"].agg(F.sum("n_papers")).first()[0] > 0
    assert made["births"].count() == made["concept_year"].select("concept").distinct().count()


def test_resolvable_horizons(spark):
    nodes = spark.createDataFrame([("r", "a"), ("s", "b")], "region_id string, node string")
    attached = spark.createDataFrame([("x", "r", 0.5, False), ("y", "r", 1.0, False), ("z", None, 0.0, True)], "concept string, unit_id string, mass double, orphan boolean")
    births = spark.createDataFrame([("x", 1997), ("y", 1998)], "concept string, crystallization_year int")
    found = {(r.unit_id, r.origin, r.horizon): r.births_mass for r in models.resolvable_targets(nodes, attached, births, [1996, 1998], [1, 2], 2000, 2).collect()}
    assert found == {("r", 1996, 1): 0.5, ("r", 1996, 2): 1.5, ("r", 1998, 1): 0.0, ("s", 1996, 1): 0.0, ("s", 1996, 2): 0.0, ("s", 1998, 1): 0.0}


def test_daily_counts_of_a_stream(spark, tmp_path):
    from chronolex.streaming import velocity

    days = [dt.datetime(2024, 1, d, 12) for d in (1, 1, 2, 9)]
    rows = [(i, d, 1, "view", 1.0, "{}") for i, d in enumerate(days)]
    spark.createDataFrame(rows, velocity.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = velocity.daily_counts(velocity.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("daily").collect()) == [("view", dt.date(2024, 1, 1), 2), ("view", dt.date(2024, 1, 2), 1), ("view", dt.date(2024, 1, 9), 1)]
