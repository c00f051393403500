"""Sharding by Karmarkar-Karp differencing: near-equal bytes for indivisible groups of equal texts.

A partial partition is a list of at most ``shards`` sums. Differencing takes the two with the largest spread and adds them
in opposite order, until one is left. Groups are dealt by their digest into pieces of bounded size, each differenced in one
task; the pieces' partial partitions are then differenced in the same way, ``FAN`` at a time, in as many levels as needed.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.llm.common import Workspace, text_or_empty

SHARDS, GROUPS, FAN, OVERHEAD = 40, 20_000, 64, 16
#: Rows in each of the buckets in which slots are numbered.
BUCKET = 500


def differencing(partials: Sequence[Sequence[int]], shards: int) -> list[list[int]]:
    """For each partial partition (a list of at most ``shards`` sums) the bin, 0 to shards-1, that each of its sums goes to.

    Ties are broken by the order of ``partials``; bins are numbered from the largest total down.
    """
    parent: list[int] = []
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    firsts = []
    for k, sums in enumerate(partials):
        firsts.append(len(parent))
        entries = sorted((s, len(parent) + i) for i, s in enumerate(sums))
        parent.extend(range(len(parent), len(parent) + len(sums)))
        heap.append((-_spread(entries, shards), k, entries))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        if len(b) > len(a):
            a, b = b, a
        both = len(a) + len(b) - shards
        if both <= 0:
            for entry in b:
                insort(a, entry)
        else:
            for i in range(both):
                (s, x), (t, y) = a[i], b[both - 1 - i]
                parent[y] = x
                a[i] = (s + t, x)
            a = sorted([*a, *b[both:]])
        heapq.heapreplace(heap, (-_spread(a, shards), serial, a))
        serial += 1
    bins = {node: i for i, (_, node) in enumerate(reversed(heap[0][2]))} if heap else {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    return [[bins[root(f + i)] for i in range(len(sums))] for f, sums in zip(firsts, partials, strict=True)]


def _spread(entries: list[tuple[int, int]], shards: int) -> int:
    return (entries[-1][0] - (entries[0][0] if len(entries) == shards else 0)) if entries else 0


def _difference_groups(groups: DataFrame, shards: int) -> DataFrame:
    """From (piece, digest, weight): piece, digest, weight, bin."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "digest"], ascending=[False, True])
        bins = differencing([[int(w)] for w in frame["weight"]], shards)
        return frame.assign(bin=[b[0] for b in bins])[["piece", "digest", "weight", "bin"]]

    return groups.groupBy("piece").applyInPandas(run, "piece long, digest binary, weight long, bin int")


def _difference_pieces(sums: DataFrame, shards: int) -> DataFrame:
    """From (above, piece, bin, weight): above, piece, bin, to, where ``to`` is the bin in the piece above."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "bin"])
        parts = [list(map(int, g)) for _, g in frame.groupby("piece")["weight"]]
        return frame.assign(to=[b for part in differencing(parts, shards) for b in part])[["above", "piece", "bin", "weight", "to"]]

    return sums.groupBy("above").applyInPandas(run, "above long, piece long, bin int, weight long, to int")


def assign_groups(groups: DataFrame, work: Workspace, shards: int = SHARDS) -> DataFrame:
    """From (digest, weight): digest, shard."""
    n_pieces = max(1, -(-groups.count() // GROUPS))
    dealt = groups.withColumn("piece", F.pmod(F.xxhash64("digest"), F.lit(n_pieces)))
    placed = work.save("pieces", _difference_groups(dealt, shards))
    sums = placed.groupBy("piece", "bin").agg(F.sum("weight").alias("weight"))
    final = None
    level = 0
    while n_pieces > 1:
        n_pieces, level = -(-n_pieces // FAN), level + 1
        steps = work.save(f"level-{level}", _difference_pieces(sums.withColumn("above", F.floor(F.col("piece") / FAN)), shards))
        sums = steps.groupBy(F.col("above").alias("piece"), F.col("to").alias("bin")).agg(F.sum("weight").alias("weight"))
        if final is None:
            final = steps.select("piece", "bin", F.col("above").alias("top"), F.col("to").alias("shard"))
        else:
            up = steps.select(F.col("piece").alias("top"), F.col("bin").alias("shard"), "above", "to")
            final = final.join(up, ["top", "shard"]).select("piece", "bin", F.col("above").alias("top"), F.col("to").alias("shard"))
    if final is None:
        return placed.select("digest", F.col("bin").alias("shard"))
    return placed.join(final, ["piece", "bin"]).select("digest", "shard")


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the UTF-8 bytes of the text plus 16; null text counts as empty. Equal texts are one group and stay in one
    shard, whatever its size; a group heavier than a shard's fair part has a shard to itself. Slots number a shard's rows
    from 0 without gaps, in an order of hashes of doc_id. Repeated rows have slots of their own. Only doc_id and text are read.
    """
    work = Workspace(docs.sparkSession, "shards")
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    rows = work.save("rows", rows)
    groups = work.save("groups", rows.groupBy("digest").agg(F.sum("size").alias("weight")))
    n_buckets = max(64, rows.count() // (shards * BUCKET))
    placed = rows.join(assign_groups(groups, work, shards), "digest").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("tie"))), F.lit(n_buckets)))
    placed = work.save("placed", placed.select("doc_id", "size", "text_crc32", "shard", "bucket", "tie"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "tie")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
