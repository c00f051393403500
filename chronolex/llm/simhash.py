"""SimHash near-dedup with pigeonring filtering.

A fingerprint of 64 bits lies on a ring of four segments of 16 bits. If two fingerprints differ in at most ``tau`` = 3
bits, some segment starts a chain whose first l segments differ in at most l * tau / 4 bits together, for every l:
0, 1, 2 and 3 bits. The first two conditions make the join key (segment start, first segment exact, second segment with
at most one bit turned), which is 32 bits wide; the third and fourth are checked on the candidates, and the fourth is the
full Hamming distance. Only distinct fingerprints are joined, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronolex.llm.common import Workspace, text_or_empty
from chronolex.llm.components import connected_components

SHINGLE, SEED, SEGMENTS, TAU = 3, 42, 4, 3
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over the word shingles of a text, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = zip(*(words[i:] for i in range(shingle)))
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    while block := list(islice(shingles, BLOCK)):
        hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, block), repeat(SEED)), np.uint64, len(block))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each row of a matrix of hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > hashes.shape[1], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and, if asked for, the text's digest for each row; null text counts as empty."""
    more = [F.unhex(F.sha2(text_or_empty(), 256)).alias("digest")] if digest else []

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
            prints = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(prints), *batch.columns[2:]], ["doc_id", "fp", *["digest"] * digest])

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(compute, "doc_id long, fp long" + ", digest binary" * digest)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _ring_mask(start: int, length: int) -> int:
    mask = reduce(int.__or__, (0xFFFF << 16 * ((start + i) % SEGMENTS) for i in range(length)))
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame) -> DataFrame:
    """a, b: all pairs a < b of the distinct fingerprints in column fp that differ in at most three bits."""
    fp = F.col("fp")
    key = lambda i: F.lit(i << 32) + F.shiftleft(_segment(fp, i), 16) + _segment(fp, i + 1)
    exact = F.array(*[key(i) for i in range(SEGMENTS)])
    turned = F.array(*[F.lit(0).cast("long")] + [F.lit(1 << p).cast("long") for p in range(16)])
    index = prints.select(F.explode(exact).alias("key"), fp.alias("b"))
    probe = prints.select(F.explode(exact).alias("exact"), fp.alias("a")).select(F.explode(F.transform(turned, lambda t: F.col("exact").bitwiseXOR(t))).alias("key"), "a")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    third = F.element_at(F.array(*[F.lit(_ring_mask(i, 3)).cast("long") for i in range(SEGMENTS)]), F.shiftrightunsigned("key", 32).cast("int") + 1)
    chain = (F.bit_count(differ.bitwiseAND(third)) <= 3 * TAU // SEGMENTS) & (F.bit_count(differ) <= TAU)
    return probe.join(index, "key").filter((F.col("a") < F.col("b")) & chain).select("a", "b").distinct()


def _grouped(docs: DataFrame, work: Workspace, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; fp, root, component_id and n_links of each distinct one."""
    rows = work.save("fingerprints", fingerprints(docs, digest))
    reps = work.save("distinct", rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = work.save("links", links(reps.select("fp")))
    roots = connected_components(pairs, work)
    degree = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = linked.join(least, "root").join(degree, "fp", "left").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, work.save("members", member)


def near_groups(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable over links, n_links the number of other distinct fingerprints linked to
    the row's own. Texts without words have fingerprint zero and link like any other; null texts count as empty. A null
    doc_id gets a row and never is a component_id, unless the component has no other. Repeated rows are all returned.
    """
    rows, member = _grouped(docs, work or Workspace(docs.sparkSession, "simhash"))
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n_links").cast("long"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest doc_id, with all columns.

    A null doc_id comes after all others; a group whose doc_ids are all null keeps one row. Rows are told apart by doc_id and
    text, so groups that share a doc_id each keep their own, and of equal rows one stays.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows, member = _grouped(docs, work, digest=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("k")
    kept = rows.join(member.select("fp", "root"), "fp").groupBy("root").agg(first)
    kept = work.save("kept", kept.select(F.col("k.doc_id").alias("_chronolex_keep"), F.col("k.digest").alias("_chronolex_sha")))
    own = docs.withColumn("_chronolex_digest", F.unhex(F.sha2(text_or_empty(), 256)))
    same = F.col("doc_id").eqNullSafe(F.col("_chronolex_keep")) & (F.col("_chronolex_digest") == F.col("_chronolex_sha"))
    stay = own.join(kept.hint("merge"), same, "left_semi")  # kept grows with the data
    if not rows.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "_chronolex_digest"])
    return stay.select(*docs.columns)
