"""Connected components of one graph or of many groups at once, step by step in joins."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Links that a task collects before it makes them a forest.
TASK_EDGES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronolex-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(frame: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again: lineage is cut, and sizes are known to the optimizer."""
    path = f"{shared_folder(frame.sparkSession)}/chronolex-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def union_find(pairs: Iterable[tuple]) -> dict:
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def count_groups(items: DataFrame, keys: list[str], item: str, links: DataFrame, link: str, within: DataFrame | None = None) -> DataFrame:
    """keys, n_groups: components of each group's items that share a link; items without a link stand alone.

    items: (keys, item), or (part, item) with within: (part, keys), the parts of each group; links: (item, link). An item and its
    links travel as one row. Where no item has several links, groups are counted by their links; else a task reads the rows of a
    group in order and holds its nodes and TASK_EDGES links at a time, so a group may have any number of items.
    """
    spark = items.sparkSession
    links = links.select(item, F.col(link).cast("string").alias("_link")).filter("_link is not null").distinct()
    names = _numbered(links.select("_link").distinct())
    of = checkpoint(links.select(item, names.alias("_id")).groupBy(item).agg(F.collect_list("_id").alias("_ids")))
    parts = keys if within is None else [c for c in within.columns if c in items.columns]
    own = items.select(*parts, item).distinct().join(of, item, "left").withColumn("_alone", F.when(F.col("_ids").isNull(), F.col(item))).drop(item)
    groups = items if within is None else within
    if within is not None:
        own = own.join(within, parts)
    if of.filter("size(_ids) > 1").isEmpty():
        return own.groupBy(*keys).agg(F.countDistinct(F.struct(F.col("_ids")[0], "_alone")).cast("int").alias("n_groups"))
    numbered = checkpoint(groups.select(F.struct(*keys).alias("_key")).distinct().withColumn("_group", F.monotonically_increasing_id()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = own.select(F.struct(*keys).alias("_key"), "_ids", F.col("_alone").cast("string").alias("_alone")).join(numbered, "_key").select("_group", "_ids", "_alone").repartition(tasks, "_group").sortWithinPartitions("_group")
    return rows.mapInArrow(_folded, "_group long, n_groups int").join(numbered, "_group").select("_key.*", "n_groups")


def _numbered(names: DataFrame) -> Column:
    """A column of numbers for the names in _link, no two of them alike: hashes, with another seed if two names share one."""
    salt = 0
    while not names.groupBy(F.xxhash64("_link", F.lit(salt)).alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        salt += 1
    return F.xxhash64("_link", F.lit(salt))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, from links between the nodes 0 to n - 1."""
    root = np.arange(n)
    while a.size:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (far := root[root]).tobytes() != root.tobytes():
            root = far
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _forest(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, root), once a node, of links (group, a, b); all groups at once."""
    groups, g = np.unique(group, return_inverse=True)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, node = np.unique(np.concatenate([g, g]) * len(names) + at, return_inverse=True)
    root = _roots(node[: len(a)], node[len(a) :], len(keys))
    return groups[keys // len(names)], names[keys % len(names)], names[keys[root] % len(names)]


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, n_groups) from rows (_group, _ids, _alone) in the order of _group: what is held is made a forest every TASK_EDGES links."""
    alone: dict[int, set] = {}
    empty = np.empty(0, np.int64)
    held, waiting, size = (empty, empty, empty), [], 0

    def fold(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting, size
        group, node, root = _forest(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
        seen = max([*group[-1:].tolist(), *alone], default=0)
        done = np.full(len(group), True) if last else group < seen
        counts = Counter(dict(zip(*(x.tolist() for x in np.unique(group[done & (node == root)], return_counts=True)), strict=True)))
        counts.update({g: len(alone.pop(g)) for g in list(alone) if last or g < seen})
        held, waiting, size = (group[~done], node[~done], root[~done]), [], 0
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int32())], ["_group", "n_groups"])

    for batch in batches:
        ids, group = batch.column("_ids"), batch.column("_group").to_numpy()
        single = ids.is_null().to_numpy(zero_copy_only=False)
        for g, name in zip(group[single].tolist(), batch.column("_alone").filter(pa.array(single)).to_pylist(), strict=True):
            alone.setdefault(g, set()).add(name)
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        flat, starts = ids.flatten().to_numpy(), np.cumsum(n) - n
        waiting.append((np.repeat(group, n), np.repeat(flat[starts[n > 0]], n[n > 0]), flat))
        size += len(flat)
        if size >= TASK_EDGES + len(held[0]):
            yield from fold(False)
    yield from fold(True)


def label_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root from (a, b): the root is the smallest node of the component; nodes without an edge are their own.

    Each task first makes forests of the edges it has, TASK_EDGES at a time. Trees that share a node are then joined: only their
    roots are followed step by step, so a node travels once for each tree that holds it. Names are strings or whole numbers.
    """
    a, b = edges.columns
    kind = edges.select(F.coalesce(a, b).alias("node")).schema["node"].dataType
    both = edges.select(F.coalesce(a, b).cast(kind).alias("a"), F.coalesce(b, a).cast(kind).alias("b")).filter("a is not null")
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        return _labels_by_steps(both, nodes)
    trees = checkpoint(both.repartition("a").mapInArrow(_trees, T.StructType([T.StructField("node", kind), T.StructField("root", kind)])))
    met = checkpoint(trees.groupBy("node").agg(F.min("root").alias("near"), F.max("root").alias("far")))
    apart = trees.join(met.filter("near != far"), "node").filter("root != near").select("near", "root").distinct()
    labels = _labels_by_steps(apart).withColumnRenamed("node", "near")
    found = met.join(labels, "near", "left").select("node", F.coalesce("root", "near").alias("root"))
    return found if nodes is None else found.union(nodes.toDF("node").distinct().join(met, "node", "left_anti").select("node", F.col("node").alias("root")))


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of trees made of the edges (a, b) at hand; a node that comes again is given again."""
    held: list = []

    def tree() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names = pa.concat_arrays([c for n in "ab" for c in table[n].chunks]).dictionary_encode()
        order = pc.sort_indices(names.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[names.indices.to_numpy()]
        root = _roots(at[: table.num_rows], at[table.num_rows :], len(order))
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(x)) for x in (order, order[root])], ["node", "root"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_EDGES:
            yield tree()
            held = []
    if any(b.num_rows for b in held):
        yield tree()


def _labels_by_steps(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The same without the forests: labels fall to the smallest neighbour, and to that one's label, until none changes."""
    a, b = edges.columns
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = checkpoint(both.union(both.select("other", "node")).distinct())
    ids = both.select("node") if nodes is None else both.select("node").union(nodes.toDF("node"))
    labels = checkpoint(ids.distinct().withColumn("root", F.col("node")))
    while True:
        least = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = labels.join(least, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        step = checkpoint(step.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.filter("new != root").limit(1).count()
        labels = step.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
