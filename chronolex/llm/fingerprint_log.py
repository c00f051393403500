"""Substring dedup on a log-structured fingerprint index.

An index is a folder of the shared store that outlives the session. It holds a few immutable runs: for each bucket, sorted
hashes of historical windows (sampled so that every window of 20 words holds one, see ``repeats``) with the document that
has each; and the texts, their digests and the verified segments of hashes met twice. ``add`` sorts a batch, merge-joins it
with the runs bucket by bucket, and verifies by their words the windows whose hash is met: of old documents only those are
read whose hash was alone till now. The batch's hashes become a new run; too many runs are compacted into one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import Workspace, squeeze_spaces, text_or_empty
from chronolex.llm.repeats import BUCKET, HIT, NONE, PASS, ROWS, Repeats, Unit, as_rows, keyed, repeated, unpack, unpack_all

WORDS = Unit(window=20, gram=8, words=True, within=True)
#: Batches in which a whole table enters the index, and runs above which the index is compacted.
BATCHES, RUNS = 4, 2
RUN, OLD = 2, 3
STATE, SEGMENT = "index.json", "cls long, sid long, seg binary, ord long, start long, n long"


def merge_runs(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes; the document is 0 where there is more than one."""
    values, docs, twice = repeated(values, docs)
    first = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    return values[first], np.where(twice, 0, docs)[first]


class FingerprintLog:
    """An index in a folder: ``FingerprintLog.open`` makes or opens it, ``add`` takes a batch, ``compact`` merges the runs.

    Its state is one small file, written last, so that a batch that fails half-way is not in the index.
    """

    def __init__(self, spark: SparkSession, folder: str, state: dict, most: int):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        self.state = state

    @classmethod
    def open(cls, spark: SparkSession, folder: str, n_bytes: int = 0, most: int = RUNS) -> FingerprintLog:
        """n_bytes: of text that the index will hold, for the number of its buckets; an index that is there keeps its own."""
        path = f"{folder.rstrip('/')}/{STATE}"
        if _exists(spark, path):
            return cls(spark, folder, json.loads("".join(r.value for r in spark.read.text(path).collect())), most)
        buckets, groups = Repeats.sizes(n_bytes)
        return cls(spark, folder, {"buckets": buckets, "groups": groups, "batches": 0, "made": 0, "runs": [], "tables": []}, most)

    def _save(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{STATE}")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(json.dumps(self.state).encode()))
        finally:
            out.close()

    def _work(self, name: str) -> Workspace:
        work = Workspace(self.spark, "log")
        work.root = f"{self.folder}/{name}"
        return work

    def _read(self, names: list[str], table: str, schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}/{table}" for n in names])

    def history(self) -> DataFrame:
        """(key, blob): the runs' sorted hashes by bucket."""
        return self._read(self.state["runs"], "run", ROWS).filter(f"kind = {RUN}").select("key", "blob")

    def _merge_join(self, blobs: DataFrame) -> DataFrame:
        """A batch (rows of kind BUCKET) against all runs: hits in the batch, hits in history (kind OLD) and the batch's run."""
        n_groups = self.state["groups"]

        def run(batch: pa.Table, history: pa.Table) -> pa.Table:
            new, owners = unpack_all(batch["blob"])
            old, had = merge_runs(*unpack_all(history["blob"]))
            new, owners, twice = repeated(new, owners)
            place = np.searchsorted(old, new)
            known = np.zeros(len(new), bool)
            inside = place < len(old)
            known[inside] = old[place[inside]] == new[inside]
            twice |= known
            met = np.unique(place[known])
            met = met[had[met] != 0]  # documents of the past that were alone with a hash till now
            now = twice & (owners != 0)
            rows = keyed(HIT, owners[now] % n_groups, new[now], owners[now]) + keyed(OLD, had[met] % n_groups, old[met], had[met])
            kept, single = merge_runs(new, np.where(twice, 0, owners))
            if len(kept):
                rows += keyed(RUN, np.full(len(kept), batch["key"][0].as_py(), np.int64), kept, single)
            return pa.Table.from_batches([as_rows(rows)])

        return blobs.filter(f"kind = {BUCKET}").select("key", "blob").groupBy("key").cogroup(self.history().groupBy("key")).applyInArrow(run, ROWS)

    def add(self, docs: DataFrame) -> DataFrame:
        """What ``remove_repeats`` says of each row of a batch, against all that the index holds and the batch itself; the batch stays in the index.

        Whatever was added before comes earlier, so batches should come in order of doc_id; what was said of them is not revised.
        """
        state, done = self.state, self.state["tables"]
        name = f"batch-{state['made']}"
        work = self._work(name)
        past = self._read(done, "digests", "digest binary, ord long") if done else None
        task = Repeats(docs, WORDS, F.trim(squeeze_spaces(text_or_empty())), work, past, state["batches"], (state["buckets"], state["groups"]))
        work.save("digests", task.texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "ord"))
        blobs = work.save("blobs", task.blobs())
        joined = work.save("run", self._merge_join(blobs))
        hits = blobs.filter(f"kind = {HIT}").unionByName(joined.filter(f"kind = {HIT}"))
        segments = work.save("new", task.segments(hits))
        every = segments
        if done:
            old_hits = joined.filter(f"kind = {OLD}")
            docs_met = old_hits.select("blob").mapInArrow(_documents, "doc long").distinct()
            seen = None
            for number, batch in enumerate(done):  # a batch's documents have numbers of their own
                texts = self._read([batch], "texts", "no long, ord long, text string").withColumn("doc", F.col("no") + F.lit(number * PASS + 1))
                seen = texts if seen is None else seen.unionByName(texts)
            seen = seen.join(docs_met, "doc", "left_semi").select("doc", "ord", "text", F.pmod("doc", F.lit(state["groups"])).alias("g"))
            fetched = work.save("fetched", task.segments(old_hits, seen))
            classes = segments.filter(F.col("cls") != NONE).select("cls").distinct()
            known = self._read(done, "segments", SEGMENT).join(classes, "cls", "left_semi")
            met = fetched.filter(F.col("cls") != NONE).select(*segments.columns)
            every = segments.unionByName(met).unionByName(known.withColumn("g", F.lit(0).cast("long")).select(*segments.columns))
            added = segments.unionByName(fetched)
        else:
            added = segments
        first = F.min(F.struct("ord", "start")).alias("first")
        own = added.filter(F.col("cls") != NONE).groupBy("cls", "sid", "seg").agg(first, F.sum("n").alias("n"))
        work.save("segments", own.select("cls", "sid", "seg", "first.ord", "first.start", "n"))
        firsts = work.save("firsts", task.firsts(every, first_windows))
        out = task.outcome(segments, firsts)
        work.only("rows", "per_text", "texts", "digests", "run", "segments")
        state["runs"].append(name)
        state["tables"].append(name)
        state["batches"] += 1
        state["made"] += 1
        if len(state["runs"]) > self.most:
            self.compact()
        self._save()
        return out.withColumnRenamed("size", "n_words")

    def compact(self) -> None:
        """Merge all runs into one and remove them; texts and segments stay as they are."""

        def run(table: pa.Table) -> pa.Table:
            values, docs = merge_runs(*unpack_all(table["blob"]))
            return pa.Table.from_batches([as_rows(keyed(RUN, np.full(len(values), table["key"][0].as_py(), np.int64), values, docs))])

        name, old = f"compact-{self.state['made']}", self.state["runs"]
        self.state["made"] += 1
        self._work(name).save("run", self.history().groupBy("key").applyInArrow(run, ROWS))
        self.state["runs"] = [name]
        self._save()
        for run_ in old:
            self._work(run_).drop("run")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners = [np.unique(unpack(b.as_buffer())[1]) for b in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(owners)) if owners else [], pa.int64())], ["doc"])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_windows(table: pa.Table, window: int = WORDS.window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each segment of a bucket, and where each window starts first: document and start. Windows are compared as text."""
    pieces = table["seg"].to_pylist()
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offsets = np.cumsum(lengths) - lengths
    text = b"".join(pieces)
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    begins, ends = np.sort(np.concatenate([offsets, space + 1])), np.sort(np.concatenate([space, offsets + lengths]))
    n_words = np.bincount(np.searchsorted(offsets, begins, "right") - 1, minlength=len(pieces))
    n = n_words - window + 1
    owner = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    at = (np.cumsum(n_words) - n_words)[owner] + place
    known: dict[bytes, int] = {}
    same = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(begins[at].tolist(), ends[at + window - 1].tolist(), strict=True)], np.int64)
    ords, starts = table["ord"].to_numpy()[owner], table["start"].to_numpy()[owner] + place
    order = np.lexsort((starts, ords, same))
    head = order[np.flatnonzero(np.diff(same[order], prepend=-1))]
    return n, ords[head][same], starts[head][same]


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, n_spans, kept_sha256.

    A word goes if a window of 20 words that covers it also starts earlier, in a document with a smaller doc_id or further
    up in the same one. The table enters a new index in batches, in order of doc_id. Null text has no words. Rows with one
    doc_id are one document; a null doc_id comes after all others. Texts of under 20 words stay whole. Only doc_id and text
    are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.sum(F.octet_length("text")).alias("n"), *([F.percentile_approx("doc_id", shares).alias("cuts")] if shares else [])).first()
    cuts = (found["cuts"] or []) if shares else []
    batch = sum((F.when(F.col("doc_id") > int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch)
    log = FingerprintLog.open(spark, Workspace(spark, "log").root, found["n"] or 0)
    out = None
    for b in range(len(cuts) + 1):
        part = log.add(docs.select("doc_id", "text").filter(batch == b))
        out = part if out is None else out.unionByName(part)
    return out
