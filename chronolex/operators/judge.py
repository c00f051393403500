"""Verdicts on terms: tolerant parsing, re-attachment and the hindsight audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a verdict line.
LINE = r"(?i)^\s*(\d+)\s*[\t,: ]\s*(KEEP|DROP)\s*$"
# Sizes that divide the strata.
STRATA = ((26, "9-25"), (61, "26-60"), (151, "61-150"), (501, "151-500"))


def parse_verdicts(lines: DataFrame) -> DataFrame:
    """(batch, line, verdict, malformed) from (batch, value); blank lines are left out."""
    number, verdict = F.regexp_extract("value", LINE, 1), F.upper(F.regexp_extract("value", LINE, 2))
    bad = number == ""
    return lines.filter(F.trim("value") != "").select("batch", F.when(~bad, number).cast("int").alias("line"), F.when(~bad, verdict).alias("verdict"), bad.alias("malformed"))


def attach_verdicts(index: DataFrame, parsed: DataFrame) -> DataFrame:
    """(term, verdict, missing) for each indexed (batch, line, term); of several verdicts DROP counts."""
    own = parsed.filter(~F.col("malformed")).groupBy("batch", "line").agg(F.min("verdict").alias("verdict"))
    return index.join(own, ["batch", "line"], "left").select("term", "verdict", F.col("verdict").isNull().alias("missing"))


def keep_unless_dropped(terms: DataFrame, verdicts: DataFrame, column: str = "term") -> DataFrame:
    """Terms without a DROP verdict; no verdict means keep."""
    return terms.join(verdicts.filter("verdict = 'DROP'").select(F.col("term").alias(column)), column, "left_anti")


def hindsight_audit(births: DataFrame, verdicts: DataFrame, least: int = 30, flag: float = 0.05) -> DataFrame:
    """stratum, keep rates of persisted and declined births, gap and flag. births: concept, fate, total_papers."""
    stratum = F.lit("501+")
    for below, name in reversed(STRATA):
        stratum = F.when(F.col("total_papers") < below, name).otherwise(stratum)
    rows = births.join(verdicts.select(F.col("term").alias("concept"), "verdict"), "concept").withColumn("stratum", stratum)
    kept = (F.col("verdict") == "KEEP").cast("double")
    of = lambda fate, x: F.when(F.col("fate") == fate, x)
    a, b = "persisted", "crystallized_then_declined"
    out = rows.groupBy("stratum").agg(*[f.alias(n) for n, f in (("n_persisted", F.count(of(a, F.lit(1)))), ("n_declined", F.count(of(b, F.lit(1)))), ("keep_persisted", F.avg(of(a, kept))), ("keep_declined", F.avg(of(b, kept))))])
    gap = F.when((F.col("n_persisted") >= least) & (F.col("n_declined") >= least), F.col("keep_persisted") - F.col("keep_declined"))
    return out.withColumn("gap", gap).withColumn("flagged", F.coalesce(F.abs("gap") >= flag, F.lit(False)))
