"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import fingerprint_log, suffixes
from chronolex.llm.bpe import round_trip
from chronolex.llm.common import bound_batches, read_table
from chronolex.llm.exact_dedup import duplicate_groups
from chronolex.llm.html_text import extract
from chronolex.llm.media import match_recordings, voiced
from chronolex.llm.mixing import mix_amounts
from chronolex.llm.quality import rate
from chronolex.llm.sharding import balanced_shards
from chronolex.llm.simhash import near_groups

#: The rank file of op2; another can be given to the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_groups(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return balanced_shards(read_table(spark, sf_dir, "documents"))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no audio, so the turns of conversations are rendered as tones, and that media column is searched."""
    bound_batches(spark)
    recordings = voiced(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return match_recordings(recordings, ["conv_id", "turn"], F.col("conv_id") % 50 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return fingerprint_log.remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_amounts(read_table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return duplicate_groups(read_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return extract(read_table(spark, sf_dir, "pages"), keep=("url",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_sharding": op3_sharding,
    "op4_chroma": op4_chroma,
    "op5_quality": op5_quality,
    "op6_fingerprint_log": op6_fingerprint_log,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffixes": op9_suffixes,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op6_fingerprint_log": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        g AS (SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        r AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, i) > 1 AS again FROM g),
        c AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
        s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM c)
        SELECT doc_id, len(any_value(w)) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
               sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
}
