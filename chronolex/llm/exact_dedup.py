"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each partition, merged, names the digests that may hold more than one part in ``counters`` of
all rows. Their exact counts and winners come from one pre-aggregated pass, are at most ``counters`` rows, and are
broadcast, so rows of large groups are resolved where they are read. All other digests go through an ordinary shuffle,
in which no key can hold more than that part of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.llm.common import Workspace, squeeze_spaces, text_or_empty

COUNTERS = 1000


def merge_counts(summary: Counter, more: Counter, counters: int) -> Counter:
    """Sum of two Misra-Gries summaries, cut back to ``counters`` keys by taking the next count off all of them."""
    summary.update(more)
    if len(summary) <= counters:
        return summary
    cut = sorted(summary.values(), reverse=True)[counters]
    return Counter({k: n - cut for k, n in summary.items() if n > cut})


def misra_gries(batches: Iterable[Iterable], counters: int = COUNTERS) -> Counter:
    """Keys with more than len/(counters + 1) occurrences are always in the result; counts are lower bounds."""
    summary: Counter = Counter()
    for keys in batches:
        summary = merge_counts(summary, Counter(keys), counters)
    return summary


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them all that hold over 1/(counters + 1) of the rows."""

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = misra_gries((f["digest"] for f in frames), counters)
        yield pd.DataFrame({"digest": list(found.keys()), "n": list(found.values())}, columns=["digest", "n"])

    partial = rows.select("digest").mapInPandas(summarise, "digest binary, n long")
    return partial.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def _digest() -> Column:
    return F.unhex(F.sha2(squeeze_spaces(text_or_empty()), 256))


def _winners(rows: DataFrame, work: Workspace, counters: int, first: Column) -> DataFrame:
    """digest, first and group_size of the frequent digests, at most ``counters`` rows, from (digest, doc_id, tie)."""
    frequent = frequent_digests(rows, counters)
    heavy = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return F.broadcast(work.save("winners", heavy))


def _first(doc_id: str = "doc_id", tie: str = "tie") -> Column:
    return F.min(F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), F.col(tie).alias("tie")))


def duplicate_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest doc_id of equal texts stays; a null doc_id comes after all others. Of repeated rows (same
    doc_id and text) exactly one is kept. Only doc_id and text are read, so other columns may have any name. An empty
    table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "exact")
    rows = work.save("digests", docs.select("doc_id", _digest().alias("digest")).withColumn("tie", F.monotonically_increasing_id()))
    heavy = _winners(rows, work, counters, _first())
    large = rows.join(heavy, "digest")
    same = Window.partitionBy("digest")
    small = rows.join(heavy, "digest", "left_anti").select("*", _first().over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size"))
    return large.unionByName(small).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long"),
        (F.col("tie") == F.col("first.tie")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one that ``duplicate_groups`` keeps.

    Copies of frequent texts go where they are read, against the broadcast winners; the texts of all others are shuffled once,
    by their digest, of which each task sends on only its first. Nulls, ties and repeated rows as in ``duplicate_groups``;
    columns may have any name but those that begin with _chronolex.
    """
    work = Workspace(docs.sparkSession, "exact")
    own = work.save("own", docs.withColumn("_chronolex_digest", _digest()).withColumn("_chronolex_tie", F.monotonically_increasing_id()))
    rows = own.select("doc_id", F.col("_chronolex_digest").alias("digest"), F.col("_chronolex_tie").alias("tie"))
    winners = _winners(rows, work, counters, _first()).select(F.col("digest").alias("_chronolex_digest"), F.col("first.tie").alias("_chronolex_first"))
    large = own.join(F.broadcast(winners), "_chronolex_digest").filter("_chronolex_tie = _chronolex_first").select(*docs.columns)
    place = F.row_number().over(Window.partitionBy("_chronolex_digest").orderBy(F.col("doc_id").asc_nulls_last(), "_chronolex_tie"))
    small = own.join(F.broadcast(winners), "_chronolex_digest", "left_anti").withColumn("_chronolex_place", place).filter("_chronolex_place = 1")
    return large.union(small.select(*docs.columns))
