"""Mixing sources to target weights, in DataFrame operations only.

Words of a source's texts form one stream, packed into blocks of ``block`` words. A source's target is a number of blocks;
all sources' blocks are put into the places of the output by one pseudorandom permutation, and ``per_shard`` places are a
shard. So every slot of a shard is drawn, and a shard's counts are multinomial given that the sources' totals are their
targets (a plain multinomial would leave a source of 30 blocks 18 % off). The q-th slot of a source takes block perm(q mod n)
of its n blocks, where perm is another permutation for each pass over the source; slots and blocks join by the block's index.
All draws are hashes of the seed and their place, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.llm.common import WORD, Workspace, n_partitions, text_or_empty

BLOCK, SLOTS, SEED, ROUNDS = 128, 4096, 7, 16
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents in each of the buckets over which the positions in a stream are summed; slots dealt to tasks together, and slots of a task.
BUCKET, CHUNK, TASK = 20_000, 4096, 1_000_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _mixed() -> Column:
    return F.xxhash64("doc_id", "text", F.lit(SEED))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each row of (source, source_size): source_no, weight, target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all sizes. No target
    is over ``most`` times its source's size: the sources with the smallest such limit by weight stop first, and the rest
    is shared by the weights of the others. One row a source; nothing else is gathered in a task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("double"))
    rows = rows.withColumn("most", F.col("source_size") * float(most)).withColumn("budget", F.sum("source_size").over(every) * float(share))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level")))
    rows = rows.withColumn("level", F.first("open", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_no", "source_size", "weight", target.alias("target"))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of 0 to n-1: swap-or-not rounds, for any n."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, other)).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def pack(rows: DataFrame, work: Workspace, **law) -> tuple[DataFrame, DataFrame]:
    """From (row, doc_id, source, size, mixed): the sources with targets, and each row with its place ``off`` in its source's stream.

    A stream's order is that of ``mixed``, a hash of doc_id and text. Positions are summed over buckets first and then within a bucket, so a source
    with most of the rows is spread over all tasks.
    """
    sources = work.save("sources", source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **law))
    n_buckets = max(64, rows.count() // BUCKET)
    placed = rows.withColumn("bucket", F.pmod("mixed", F.lit(n_buckets)))
    own = sources.select(F.col("source").alias("_source"), "source_no")
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("mixed", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    packed = within.join(starts, ["source_no", "bucket"]).select("row", "doc_id", "source_no", "size", (F.col("start") + F.col("inside")).alias("off"))
    return sources, work.save("packed", packed)


def pieces(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """What of each document lies in which block: source_no, block, row, first (word in the document), words."""
    last = F.col("off") + F.col("size")
    cut = packed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((last - 1) / block))))
    begin = F.greatest(F.col("block") * block, F.col("off"))
    return cut.select("source_no", "block", "row", (begin - F.col("off")).alias("first"), (F.least((F.col("block") + 1) * block, last) - begin).alias("words"))


def slots(sources: DataFrame, block: int = BLOCK, per_shard: int = SLOTS, most: float = MOST) -> DataFrame:
    """The blocks that the mix takes: shard, source_no, q (place in the source's sequence), pass_no, block.

    Only the table of sources is numbered in one task; its slots are dealt to tasks in chunks.
    """
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.filter("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block))
    rows = rows.withColumn("amount", F.least(F.round(F.col("target") * F.col("n") / F.col("source_size")), F.floor(F.col("n") * float(most))).cast("long"))
    rows = rows.withColumn("begin", F.coalesce(F.sum("amount").over(order), F.lit(0))).withColumn("all", F.sum("amount").over(Window.partitionBy()))
    total = rows.agg(F.sum("amount")).first()[0] or 0
    parts = rows.filter("amount > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("amount") - 1) / CHUNK))))
    parts = parts.repartition(max(n_partitions(sources.sparkSession), total // TASK), "source_no", "part")
    taken = parts.withColumn("q", F.explode(F.sequence(F.col("part") * CHUNK, F.least((F.col("part") + 1) * CHUNK, F.col("amount")) - 1)))
    taken = taken.withColumn("pass_no", F.floor(F.col("q") / F.col("n")))
    place, block_no = permuted(F.col("begin") + F.col("q"), F.col("all"), F.lit(SEED)), permuted(F.pmod("q", "n"), F.col("n"), F.lit(SEED), F.col("source_no"), F.col("pass_no"))
    return taken.select(F.floor(place / per_shard).alias("shard"), "source_no", "q", "pass_no", block_no.alias("block"))


def mixed_pieces(sources: DataFrame, packed: DataFrame) -> DataFrame:
    """shard, q, pass_no, source_no, block, row, first, words: the mix, one row for each piece of a document in a taken block.

    Both sides grow with the data, though their estimated sizes are those of the small tables they are made of; so neither
    is broadcast.
    """
    return slots(sources).hint("merge").join(pieces(packed).hint("merge"), ["source_no", "block"])


def mix_amounts(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null text has size 0; null is a source. A text without words, and all of a table without words, takes no part. Repeated
    rows and rows with a null doc_id are documents of their own. Only doc_id, source and text are read. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words(text_or_empty()).alias("size"), _mixed().alias("mixed"))
    rows = work.save("rows", rows)
    sources, packed = pack(rows, work)
    taken = mixed_pieces(sources, packed).groupBy("row").agg(F.sum("words").alias("taken"))
    return packed.hint("merge").join(taken, "row", "left").join(sources.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and pass over its source one row, with all columns of ``docs``.

    A document that a pass takes whole keeps its text; of one that it takes in part, the taken words stay in their order,
    joined by one space, and n_chars is counted anew. Documents of which the mix takes no block are not in the result.
    """
    work = Workspace(docs.sparkSession, "mix")
    own = work.save("own", docs.withColumn("_chronolex_row", F.monotonically_increasing_id()).withColumn("_chronolex_size", n_words(text_or_empty())))
    sources, packed = pack(own.select(F.col("_chronolex_row").alias("row"), "doc_id", "source", F.col("_chronolex_size").alias("size"), _mixed().alias("mixed")), work)
    spans = mixed_pieces(sources, packed).groupBy("row", "pass_no").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_chronolex_spans"))
    spans = spans.select(F.col("row").alias("_chronolex_row"), F.col("words").alias("_chronolex_words"), "_chronolex_spans")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    joined = own.join(spans, "_chronolex_row").withColumn("_chronolex_list", F.when(F.col("_chronolex_words") < F.col("_chronolex_size"), words))
    some = F.array_join(F.flatten(F.transform("_chronolex_spans", lambda s: F.slice(F.col("_chronolex_list"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
    out = joined.withColumn("text", F.when(F.col("_chronolex_words") < F.col("_chronolex_size"), some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_chronolex_words") < F.col("_chronolex_size"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
