"""Near copies by word shingles: SimHash fingerprints, the pigeonring principle for candidates, the shingles decide.

The query op1 has its own contract (``simhash``): one fingerprint of 64 bits a text. At a similarity of 0.8 these differ in some
ten bits, and no key of bits is selective for so many without losing pairs. Here the ring is therefore made of shingles: a text's
shingles lie on it in the order of their hashes, and fingerprints are SimHashes, by op1's rule, of stretches of that ring.

Each shingle of two texts is a box, which counts s / (1 - s) if only one text has it and -1 if both have. At similarity s or above
the boxes sum to at most nothing, so from some start on each chain of the first l boxes does, for every l. The first s / (1 - s)
boxes of that chain (four at 0.8) are shingles of both texts: neighbours in either's ring, with one SimHash. These conditions are
the join key. With every start as a key no pair is lost. A text of 128 and more shingles takes the starts whose hash falls into a
power of two, so that 64 to 127 remain on average: a pair at 0.8 shares 0.45 of its starts, and has none left with a probability
below 1e-11. In each bucket all are compared with its first text; buckets that then still hold several components are compared
in full across these, so that a dense group costs one comparison a text.

The last condition, on the whole ring, filters. It takes SimHashes of ``BINS`` segments of the ring, ``PLANES`` bits of each.
Segments that differ hold a shingle that only one text has, so there are no more of them than such shingles, and at similarity s
these are at most (1 - s) / (1 + s) of both texts' shingles. The condition is part of the join: pairs that it prunes are never
rows. Texts of the rest are fetched and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronolex.llm.common import Workspace, text_or_empty
from chronolex.llm.components import connected_components
from chronolex.llm.simhash import SEED, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Starts of chains that a text keeps at least, on average, if it has so many.
STARTS = 64
#: Segments of a ring and bits of the SimHash of each; longs in one plane of bits.
BINS, PLANES = 512, 3
LONGS = BINS // 64
#: Standard deviations by which segments of very long texts may differ beyond what is expected at the similarity asked for.
SIGMAS = 6
METHOD = "spark.sql.codegen.hugeMethodLimit"


def shingles(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """Runs of ``size`` words; a shorter text is one run, a text without words the empty one."""
    words = text.lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) > size else {b" ".join(words)}


def similar(a: bytes, b: bytes, size: int = SHINGLE, least: float = SIMILARITY) -> bool:
    a, b = shingles(a, size), shingles(b, size)
    both = len(a & b)
    return both / (len(a) + len(b) - both) >= least


def chain_length(least: float = SIMILARITY) -> int:
    """Boxes at the start of a chain that two texts of that similarity share."""
    return max(1, ceil(least / max(1 - least, 1 / 64) - 1e-9))


def chain_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """One long for each start of a chain: the SimHash of the ``length`` shingles that follow each other on the ring from there."""
    boxes = np.unique(hashes)
    if len(boxes) <= length:
        return majority(boxes[None]).view(np.int64)
    one_of = 1 << max(0, (len(boxes) // STARTS).bit_length() - 1)
    starts = np.flatnonzero((boxes >> np.uint64(20)) & np.uint64(one_of - 1) == 0)
    return np.unique(majority(boxes[(starts[:, None] + np.arange(length)) % len(boxes)]).view(np.int64))


def ring(hashes: np.ndarray) -> np.ndarray:
    """PLANES x LONGS longs: bits of the SimHash of the shingles of each segment, zero for a segment without a shingle."""
    segment = (hashes >> np.uint64(55)).astype(np.int64)
    ones = [np.bincount(segment, (hashes >> np.uint64(i)) & np.uint64(1), BINS) for i in range(PLANES)]
    return np.packbits(2 * np.stack(ones) > np.bincount(segment, minlength=BINS), axis=1, bitorder="little").view(np.int64).ravel()


def may_be_similar(least: float) -> Column:
    """Whether the sketches (ring_a, ring_b) and shingle counts (n_a, n_b) allow a similarity of ``least``; never false for a similar pair
    of texts but for very long ones, and for those with a probability below 1e-8."""
    both = F.col("n_a") + F.col("n_b")
    turns = 1 - (1 - acos(2 * least / (1 + least)) / pi) ** PLANES  # the part of segments that differ in very long texts; less in others
    budget = F.least(both * ((1 - least) / (1 + least)), F.lit(BINS * turns + SIGMAS * (BINS * turns * (1 - turns)) ** 0.5)) + 1e-6
    turned = [F.col("ring_a")[i].bitwiseXOR(F.col("ring_b")[i]) for i in range(PLANES * LONGS)]
    plane = reduce(Column.__add__, [F.bit_count(turned[i]) for i in range(LONGS)])  # the cheap part first
    differ = reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, turned[i::LONGS])) for i in range(LONGS)])
    return (F.abs(F.col("n_a") - F.col("n_b")) <= both * ((1 - least) / (1 + least)) + 1e-6) & (plane <= budget) & (differ <= budget)


def _save_joined(work: Workspace, name: str, frame: DataFrame) -> DataFrame:
    """Write a join on ``may_be_similar``. In one method of whole-stage code it is too long for the JVM to compile; Spark else splits it."""
    held = work.spark.conf.get(METHOD, "65535")
    work.spark.conf.set(METHOD, "8000")
    try:
        return work.save(name, frame)
    finally:
        work.spark.conf.set(METHOD, held)


def _digest() -> Column:
    return F.unhex(F.sha2(text_or_empty(), 256))


def sketches(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (of the text as it is; null counts as empty), keys of chains, ring and n (shingles) of each row."""
    length = chain_length(least)

    def lists(values: list[np.ndarray]) -> pa.Array:
        flat = pa.array(np.concatenate(values) if values else np.array([], np.int64))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)], dtype=np.int32)), flat)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rings, sizes = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_buffer().to_pybytes(), size)
                hashes = np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
                keys.append(chain_keys(hashes, length))
                rings.append(ring(hashes))
                sizes.append(len(found))
            made = [lists(keys), lists(rings), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "digest", "keys", "ring", "n"])

    rows = docs.select("doc_id", _digest().alias("digest"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(compute, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary, keys array<long>, ring array<long>, n long")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, work: Workspace, step: str, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of node ids whose texts are similar; only texts of these pairs are shuffled."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), size, least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = nodes.select("id", "digest").join(ids, "id")
    texts = docs.select(_digest().alias("digest"), text_or_empty().cast("binary").alias("text")).join(wanted, "digest").dropDuplicates(["id"])
    texts = work.save(f"texts-{step}", texts.select("id", "text"))
    of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    links = work.save(f"links-{step}", rows.mapInArrow(compare, "a long, b long"))
    work.drop(f"texts-{step}")
    return links


def _rooted(nodes: DataFrame, links: DataFrame, work: Workspace, step: str) -> DataFrame:
    roots = connected_components(links, Workspace(work.spark, f"roots-{step}"))
    return nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def similar_nodes(docs: DataFrame, rows: DataFrame, work: Workspace, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """id, digest, first (of its rows' doc_ids the smallest, null after all others) and root of each distinct text of ``rows``, the sketches."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("first")
    nodes = rows.groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("keys", "ring", "n")]).withColumn("id", F.monotonically_increasing_id())
    nodes = work.save("nodes", nodes)
    buckets = nodes.select("id", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = work.save("shared", buckets.join(heads.hint("merge"), "key").select("key", "id", "a"))
    starred = shared.filter("id > a").select("a", F.col("id").alias("b")).distinct()
    sketch = lambda c: nodes.select(F.col("id").alias(c), F.col("ring").alias(f"ring_{c}"), F.col("n").alias(f"n_{c}"))
    near = sketch("b").withColumnRenamed("b", "id_b")
    pairs = starred.join(sketch("a").hint("merge"), "a").join(near.hint("merge"), (F.col("b") == F.col("id_b")) & may_be_similar(least)).select("a", "b")
    pairs = _save_joined(work, "pairs", pairs)
    links = _verified(docs, nodes, pairs, work, "first", size, least)
    placed = work.save("placed", shared.join(_rooted(nodes.select("id"), links, work, "first").hint("merge"), "id").select("key", "id", "root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    open_ = work.save("open", placed.join(mixed.hint("merge"), "key").join(nodes.select("id", "keys", "ring", "n").hint("merge"), "id"))
    side = lambda c: open_.select(*[F.col(x).alias(f"{x}_{c}") for x in ("key", "id", "root", "keys", "ring", "n")])
    apart = (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
    here = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a")  # a pair is made in the first bucket that it shares
    across = side("a").hint("merge").join(side("b"), apart & may_be_similar(least) & here)
    rest = _save_joined(work, "rest", across.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).join(pairs, ["a", "b"], "left_anti"))
    links = links.union(_verified(docs, nodes, rest, work, "rest", size, least))
    return _rooted(nodes.drop("keys", "ring", "n"), links, work, "all")


def drop_similar(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts the one with the smallest doc_id, with all columns.

    A group is what chains of pairs at ``least`` or above connect. A null doc_id comes after all others; a group whose doc_ids
    are all null keeps one row. Rows are told apart by doc_id and text, and of equal ones a single row stays.
    """
    work = Workspace(docs.sparkSession, "near")
    rows = work.save("sketches", sketches(docs, size, least))
    nodes = similar_nodes(docs, rows, work, size, least)
    kept = nodes.groupBy("root").agg(F.min(F.struct("first.last", "first.doc_id", "id", "digest")).alias("k"))
    kept = work.save("kept", kept.select(F.col("k.doc_id").alias("_chronolex_keep"), F.col("k.digest").alias("_chronolex_sha")))
    own = docs.withColumn("_chronolex_digest", _digest())
    stay = own.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_chronolex_keep")) & (F.col("_chronolex_digest") == F.col("_chronolex_sha")), "left_semi")
    if not rows.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "_chronolex_digest"])
    return stay.select(*docs.columns)
