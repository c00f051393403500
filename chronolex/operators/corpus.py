"""Ingest filters, candidate terms and the ledger."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronolex.functions.text import STOPWORDS, author_key, first_date, n_tokens, squeeze

RAKE, CHUNK, NGRAM = 1, 2, 4
#: Rows a task hands on at once, and words it numbers at once.
MOST_ROWS, MOST_WORDS = 50_000, 1_000_000
NOUN, ADJ = ("NOUN", "PROPN"), ("ADJ",)
# Tags that end a segment.
BARRIERS = ("PUNCT", "SPACE", "SYM", "X")


def drop_reason(records: DataFrame, wanted: list[str], cutoff: str) -> DataFrame:
    """Every record with the first reason that drops it, in the order of the filters; null for kept ones.

    records: pos (order of arrival), id, title, abstract, categories, comments, created.
    """
    w = Window.partitionBy("id").orderBy("pos")
    text, day = squeeze(F.coalesce("abstract", F.lit(""))), first_date(F.col("created"))
    matched = F.arrays_overlap(F.split(squeeze(F.col("categories")), " "), F.array(*map(F.lit, wanted)))
    seen = records.withColumn("matched", F.coalesce(matched, F.lit(False)))
    first = F.row_number().over(w.partitionBy("matched", "id"))
    withdrawn = F.coalesce(F.col("comments"), F.lit("")).rlike(r"(?i)\bwithdraw") | text.rlike(r"(?i)^(this|the) (paper|submission|article|manuscript) (has been|is|was) withdrawn")
    reason = (
        F.when(~F.col("matched"), "category")
        .when((F.coalesce("id", F.lit("")) == "") | (first > 1), "duplicate")
        .when(withdrawn, "withdrawn")
        .when(day.isNull(), "no_date")
        .when(day > F.to_date(F.lit(cutoff)), "after_cutoff")
        .when(text == "", "empty_abstract")
    )
    return seen.withColumn("v1_date", day).withColumn("drop_reason", reason).drop("matched")


def papers(records: DataFrame, wanted: list[str], cutoff: str, flags: dict[str, str] | None = None) -> DataFrame:
    """Kept records as dated papers with derived columns; author keys are squeezed and lower-cased."""
    kept = drop_reason(records, wanted, cutoff).filter("drop_reason is null")
    categories = F.split(squeeze(F.col("categories")), " ")
    out = kept.select(
        "id", squeeze(F.col("title")).alias("title"), squeeze(F.col("abstract")).alias("abstract"), "categories", categories[0].alias("primary_category"),
        *[F.array_contains(categories, c).alias(name) for name, c in (flags or {}).items()],
        F.transform("authors", author_key).alias("authors_parsed"), F.size("authors").alias("n_authors"), "v1_date",
        F.year("v1_date").cast("short").alias("v1_year"), F.quarter("v1_date").cast("byte").alias("v1_quarter"), F.col("n_versions").cast("short").alias("n_versions"),
    )
    return out


def _barrier(t: Column) -> Column:
    return t["pos"].isin(*BARRIERS) | ~t["lemmas"].rlike(r"[\p{L}\p{N}]")


def _tokens() -> Column:
    return F.arrays_zip("lemmas", "pos")


def noun_chunks(tagged: DataFrame, most: int = 5, doc: str = "id") -> DataFrame:
    """(doc, cand): maximal runs of adjectives and then nouns, and every suffix of them, of at most ``most`` tokens.

    A document is read once, as a string of its tokens with a mark of their class and line breaks where a run ends: at any
    other token, and before an adjective after a noun. Nothing is shuffled but what leaves it.
    """
    word = lambda t: t["lemmas"].rlike(r"[\p{L}\p{N}]")
    noun, adj = (lambda t: word(t) & t["pos"].isin(*NOUN)), (lambda t: word(t) & t["pos"].isin(*ADJ))
    kind = F.transform(_tokens(), lambda t: F.when(noun(t), "N").when(adj(t), "A").otherwise("-"))
    rows = tagged.select(doc, "lemmas", kind.alias("_k"))
    after = lambda i: (i > 0) & (F.coalesce(F.get("_k", i - 1), F.lit("")) == "N")
    piece = lambda w, i: F.when(F.get("_k", i) == "N", F.concat(w, F.lit("\u0001"))).when(F.get("_k", i) == "A", F.concat(F.when(after(i), "\n ").otherwise(""), w)).otherwise("\n")
    runs = F.filter(F.split(F.array_join(F.transform("lemmas", piece), " "), "\n"), lambda r: F.contains(r, F.lit("\u0001")))
    spans = F.transform(runs, lambda r: F.split(F.trim(F.translate(r, "\u0001", "")), " "))
    suffixes = lambda w: F.transform(F.sequence(F.lit(1), F.least(F.size(w), F.lit(most))), lambda n: F.array_join(F.slice(w, -n, n), " "))
    return rows.select(doc, F.explode(F.array_distinct(F.flatten(F.transform(spans, suffixes)))).alias("cand"))


def rake_phrases(tagged: DataFrame, stop: frozenset[str] = STOPWORDS, most: int = 5, doc: str = "id") -> DataFrame:
    """(doc, cand): runs between stop words and barriers of at most ``most`` tokens. The phrases only; they aren't scored."""
    text = F.array_join(F.transform(_tokens(), lambda t: F.when(~_barrier(t) & ~t["lemmas"].isin(*sorted(stop)), t["lemmas"])), " ", "\n")
    runs = F.filter(F.split(text, r" ?\n ?"), lambda r: (r != "") & (n_tokens(r) <= most))
    return tagged.select(doc, F.explode(F.array_distinct(runs)).alias("cand"))


def ngram_postings(words: DataFrame, sizes: tuple[int, ...] = (2, 3), keys: tuple[str, ...] = ("id", "v1_date")) -> DataFrame:
    """(keys, cand) once a document: all n-grams of the array ``words`` that hold a letter and no barrier."""
    rows = words.select(*keys, "words").filter("words is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for names, place, doc in _gram_places(batch.column("words"), sizes):
                for i in range(0, len(doc), MOST_ROWS):
                    at = pa.array(doc[i : i + MOST_ROWS])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), names.take(pa.array(place[i : i + MOST_ROWS]))], [*keys, "cand"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), T.StructField("cand", T.StringType())]))


def ngram_counts(words: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(cand, df): in how many documents each n-gram of ``ngram_postings`` is; each task counts the documents it has at hand first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for names, place, _ in _gram_places(batch.column("words"), sizes):
                df = np.bincount(place, minlength=len(names))
                for i in range(0, len(df), MOST_ROWS):
                    n = df[i : i + MOST_ROWS]
                    yield pa.RecordBatch.from_arrays([names.slice(i, MOST_ROWS).filter(pa.array(n > 0)), pa.array(n[n > 0])], ["cand", "n"])

    return words.select("words").filter("words is not null").mapInArrow(run, "cand string, n long").groupBy("cand").agg(F.sum("n").alias("df"))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of about MOST_WORDS words, a document at least."""
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy()), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + MOST_WORDS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _gram_places(words: pa.ListArray, sizes: tuple[int, ...]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each size: the n-grams' names, and (name, document) by number, once a document.

    An n-gram is numbered by its first n - 1 words' number and its last word's, so that numbers are compared and not names.
    """
    tokens = words.flatten().cast(pa.string()).fill_null("").dictionary_encode()
    own, code = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    kind = np.fromiter((_kind(t) for t in own.to_pylist()), np.int8, len(own))
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    at = np.flatnonzero(kind[code] > 0)
    names, letter, place = own, kind == 2, code[at]
    for n in range(1, max(sizes) + 1):
        if n > 1:
            end = at + n - 1
            on = end < len(code)
            on[on] = (kind[code[end[on]]] > 0) & (doc[end[on]] == doc[at[on]])
            at, place, last = at[on], place[on], code[end[on]]
            number, place = np.unique(place * len(own) + last, return_inverse=True)
            head, last = number // max(1, len(own)), number % max(1, len(own))
            names, letter = pc.binary_join_element_wise(names.take(pa.array(head)), own.take(pa.array(last)), " "), letter[head] | (kind[last] == 2)
        if n in sizes:
            held = letter[place]
            once = np.sort(doc[at[held]] * max(1, len(names)) + place[held])  # numpy's unique would hash, at ten times the cost
            once = once[np.diff(once, prepend=-1) != 0]
            yield names, once % max(1, len(names)), once // max(1, len(names))


def _kind(token: str) -> int:
    """0 for a barrier, 1 for a token with a digit, 2 for one with a letter."""
    if token.isascii() and token.isalpha():
        return 2
    classes = {unicodedata.category(c)[0] for c in token}
    return 2 if "L" in classes else 1 if "N" in classes else 0


def provenance(extracted: dict[int, DataFrame]) -> DataFrame:
    """(cand, src_mask): all extractors' candidates that hold a letter, with OR-ed provenance."""
    every = None
    for mask, rows in extracted.items():
        one = rows.select("cand", F.lit(mask).alias("src_mask"))
        every = one if every is None else every.unionByName(one)
    return every.filter(F.col("cand").rlike(r"\p{L}")).groupBy("cand").agg(F.bit_or("src_mask").alias("src_mask"))


def nominated(masks: DataFrame, sizes: tuple[int, int] = (2, 3)) -> DataFrame:
    """The candidates of sizes that the n-grams don't cover; these are counted by a second pass."""
    n = n_tokens(F.col("cand"))
    return masks.filter((n < sizes[0]) | (n > sizes[1]))


def nominations(extracted: dict[int, DataFrame]) -> DataFrame:
    """(cand, src_mask): all extractors' candidates with OR-ed provenance; of one and of four and more tokens, with a letter."""
    return nominated(provenance(extracted))


def dictionary_postings(words: DataFrame, terms: DataFrame, sizes: tuple[int, ...], keys: tuple[str, ...] = ("id", "v1_date")) -> DataFrame:
    """(keys, cand): occurrences of the dictionary's terms anywhere in a document, once each."""
    return ngram_postings(words, sizes, keys).join(terms.select("cand"), "cand", "left_semi").select(*keys, "cand")


def postings(words: DataFrame, masks: DataFrame, most: int = 5, sizes: tuple[int, int] = (2, 3), keys: tuple[str, ...] = ("id", "v1_date")) -> DataFrame:
    """(keys, cand, own_mask) of both passes: every n-gram of ``sizes``, and where the nominated candidates of other sizes occur."""
    first = ngram_postings(words, tuple(range(sizes[0], sizes[1] + 1)), keys).withColumn("own_mask", F.lit(NGRAM))
    others = tuple(n for n in range(1, most + 1) if not sizes[0] <= n <= sizes[1])
    second = dictionary_postings(words, nominated(masks, sizes), others, keys).withColumn("own_mask", F.lit(0))
    return first.unionByName(second)


def all_postings(words: DataFrame, most: int = 5, keys: tuple[str, ...] = ("id", "v1_date")) -> DataFrame:
    """(keys, cand): the n-grams of all sizes, in one pass; which of them count is settled by ``covered`` once they are aggregated."""
    return ngram_postings(words, tuple(range(1, most + 1)), keys)


def covered(table: DataFrame, masks: DataFrame, sizes: tuple[int, int] = (2, 3)) -> DataFrame:
    """Rows by cand with own_mask: every n-gram of ``sizes``, with NGRAM, and the nominated candidates of other sizes; src_mask from masks."""
    own = F.when(n_tokens(F.col("cand")).between(*sizes), NGRAM).otherwise(0)
    rows = table.join(masks.select("cand", "src_mask"), "cand", "left").withColumn("own_mask", own)
    return rows.filter((F.col("own_mask") > 0) | F.col("src_mask").isNotNull())


def ledger(postings: DataFrame, masks: DataFrame | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """cand, df, first_date, first_paper_id, n_tokens, src_mask from (id, v1_date, cand) and own_mask, which is NGRAM if it is not given.

    masks: (cand, src_mask) of the extractors; with ``sizes`` postings are ``all_postings``, of which ``covered`` are kept. Ties of dates go to the smaller id. Dates and whole ids are compared as one number, for which an aggregation need not sort.
    """
    whole = isinstance(postings.schema["id"].dataType, T.IntegralType)
    day, number = F.unix_date("v1_date").cast("decimal(10,0)"), F.col("id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    step = F.lit(str(10**20)).cast("decimal(21,0)")
    first = F.min((day * step + number).cast("decimal(38,0)")) if whole else F.min(F.struct("v1_date", "id"))
    own = F.max("own_mask") if "own_mask" in postings.columns else F.lit(NGRAM)
    total = postings.groupBy("cand").agg(F.count(F.lit(1)).alias("df"), first.alias("first"), own.alias("own_mask"))
    if whole:
        rest = F.pmod("first", step)
        at, who = F.date_from_unix_date(((F.col("first") - rest) / step).cast("int")), (rest - F.lit(str(2**63)).cast("decimal(20,0)")).cast(postings.schema["id"].dataType)
    else:
        at, who = F.col("first.v1_date"), F.col("first.id")
    if masks is not None:
        total = covered(total, masks, sizes) if sizes else total.join(masks.select("cand", "src_mask"), "cand", "left")
        total = total.withColumn("own_mask", F.col("own_mask").bitwiseOR(F.coalesce("src_mask", F.lit(0))))
    return total.select("cand", "df", at.alias("first_date"), who.alias("first_paper_id"), n_tokens(F.col("cand")).cast("int").alias("n_tokens"), F.col("own_mask").alias("src_mask"))


def ledger_yearly(postings: DataFrame, masks: DataFrame | None = None, sizes: tuple[int, int] = (2, 3)) -> DataFrame:
    """cand, year, n_papers; with masks postings are ``all_postings``, of which ``covered`` are kept."""
    total = postings.groupBy("cand", F.year("v1_date").alias("year")).agg(F.count(F.lit(1)).cast("int").alias("n_papers"))
    return total if masks is None else covered(total, masks, sizes).select("cand", "year", "n_papers")


def missing_terms(table: DataFrame, spot: list[str]) -> DataFrame:
    """Acceptance: the spot terms that the ledger lacks; one semi-join instead of a lookup for each."""
    terms = table.sparkSession.createDataFrame([(t,) for t in spot], "cand string")
    return terms.join(table, "cand", "left_anti")
