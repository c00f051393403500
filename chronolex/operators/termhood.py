"""Parts of speech, pattern kills, C-value and the vocabulary as of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.text import STOPWORDS, n_tokens
from chronolex.operators.components import checkpoint

# Ordinals at the head of a name, tags of a predicate, and words too general to name anything alone.
ORDINAL = r"(?i)^([0-9]+(st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|next|last|previous|former|latter)$"
PREDICATE = ("VERB", "AUX")
GENERIC = frozenset(
    """model models method methods approach approaches system systems framework frameworks technique techniques algorithm algorithms result results experiment experiments paper papers work works
    study studies task tasks problem problems dataset datasets data set sets analysis application applications performance accuracy evaluation case cases example examples number amount level
    levels type types kind form forms way ways part parts step steps stage stages state states process processes value values feature features function functions structure structures property
    properties information effect effects use uses user users time times year years research field area areas domain domains context term terms""".split()
)


def tag(lemma: Column, stop: frozenset[str] = STOPWORDS) -> Column:
    """A tagger of rules: function words, then endings, else noun. Anything downstream needs lemma and pos only.

    A hyphenated compound has the tag of its last part, but a participle in it is an adjective.
    """
    return (
        F.when(~lemma.rlike(r"[\p{L}\p{N}]"), "PUNCT")
        .when(lemma.isin(*sorted(stop)), "DET")
        .when(~lemma.rlike(r"\p{L}"), "NUM")
        .when(lemma.endswith("ly"), "ADV")
        .when(lemma.rlike("(ing|ed)$"), F.when(lemma.contains("-"), "ADJ").otherwise("VERB"))
        .when(lemma.rlike("(ous|ive|al|ble)$"), "ADJ")
        .otherwise("NOUN")
    )


def lemma_pos_counts(words: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lemma, pos, n) from arrays lemmas and pos; parallel arrays are zipped, never crossed."""
    rows = words.select(*keys, F.explode(F.arrays_zip("lemmas", "pos")).alias("t"))
    return rows.groupBy(*keys, F.col("t.lemmas").alias("lemma"), F.col("t.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def dominant_pos(counts: DataFrame, as_of: int | None = None) -> DataFrame:
    """lemma, dominant_pos, n_tokens, dominance; with ``as_of`` from counts of years up to it. Ties go to the later name."""
    if as_of is not None:
        counts = counts.filter(F.col("year") <= as_of).groupBy("lemma", "pos").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", "pos"))
    out = counts.groupBy("lemma").agg(best.alias("best"), F.sum("n").alias("n_tokens"))
    return out.select("lemma", F.col("best.pos").alias("dominant_pos"), "n_tokens", (F.col("best.n").cast("double") / F.col("n_tokens")).alias("dominance"))


def kill_reasons(cands: DataFrame, pos: DataFrame, strict: bool = True, nominal: bool = True, stop: frozenset[str] = STOPWORDS) -> DataFrame:
    """cands with kill_reason, the first that holds: empty, verb_led, ordinal, stopword_straddler, non_nominal_head, generic_head, no_alpha; else keep.

    strict: a function word anywhere kills, else only at an end. nominal: the last word must be tagged as a noun.
    """
    rows = cands.withColumn("_w", F.filter(F.split("cand", " "), lambda w: w != "")).withColumn("_first", F.try_element_at("_w", F.lit(1))).withColumn("_last", F.try_element_at("_w", F.lit(-1)))
    tags = pos.select("lemma", "dominant_pos")
    rows = rows.join(tags.select(F.col("lemma").alias("_first"), F.col("dominant_pos").alias("_first_pos")), "_first", "left")
    rows = rows.join(tags.select(F.col("lemma").alias("_last"), F.col("dominant_pos").alias("_last_pos")), "_last", "left")
    function, generic = sorted(stop), sorted(GENERIC)
    straddles = F.exists("_w", lambda w: w.isin(*function)) if strict else F.col("_first").isin(*function) | F.col("_last").isin(*function)
    reason = F.when(F.size("_w") == 0, "empty").when(F.col("_first_pos").isin(*PREDICATE), "verb_led").when(F.col("_first").rlike(ORDINAL), "ordinal").when(straddles, "stopword_straddler")
    if nominal:
        reason = reason.when(~F.coalesce(F.col("_last_pos"), F.lit("")).isin("NOUN", "PROPN"), "non_nominal_head")
    reason = reason.when(F.forall("_w", lambda w: w.isin(*generic, *function)), "generic_head").when(~F.col("cand").rlike(r"\p{L}"), "no_alpha").otherwise("keep")
    return rows.withColumn("kill_reason", reason).drop("_w", "_first", "_last", "_first_pos", "_last_pos")


def subterms(cand: Column) -> Column:
    """All proper sub-sequences of tokens of a name, each once."""
    words = F.split(cand, " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.when(n > 1, F.array_distinct(spans)).otherwise(F.array().cast("array<string>"))


def c_value(terms: DataFrame) -> DataFrame:
    """terms (cand, df, ...) with c_value = log2(tokens + 1) * (df - mean df of containers) and n_containers. They are written, as they are read three times."""
    terms = checkpoint(terms)
    inside = terms.filter(n_tokens(F.col("cand")) > 1).select(F.explode(subterms(F.col("cand"))).alias("cand"), F.col("df").alias("of"))
    nested = inside.join(terms.select("cand"), "cand", "left_semi").groupBy("cand").agg(F.avg("of").alias("mean"), F.count(F.lit(1)).cast("int").alias("n_containers"))
    value = F.log2(n_tokens(F.col("cand")) + 1.0) * (F.col("df") - F.coalesce("mean", F.lit(0.0)))
    return terms.join(nested, "cand", "left").withColumn("c_value", value).withColumn("n_containers", F.coalesce("n_containers", F.lit(0))).drop("mean")


def floors(values: DataFrame, column: str, at: list[float]) -> DataFrame:
    """How many values lie over each floor, in one pass."""
    one = values.agg(*[F.sum((F.col(column) > f).cast("long")).alias(f"f{i}") for i, f in enumerate(at)])
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("n_above")) for i, f in enumerate(at)])
    return one.select(F.inline(pairs))


def resolve(term: Column, cluster: Column, effective: Column, asof: Column) -> Column:
    """The concept of a term as of a day: its cluster once the merge is in effect, else itself."""
    return F.when(effective <= asof, cluster).otherwise(term)


def vocabulary(yearly: DataFrame, counts: DataFrame, merge_map: DataFrame, postings: DataFrame, origin: int, min_df: int, floor: float = 0.0, dropped: DataFrame | None = None) -> DataFrame:
    """cluster, df_t, n_members, c_value, first_date as of a year, from nothing dated after it.

    yearly (cand, year, n_papers); counts (lemma, pos, year, n); merge_map (cand, cluster, effective_date); postings (id, v1_date, cand).
    A cluster whose own label does not survive is no cluster: its members stand alone. Judged-out clusters go; without a
    verdict they stay.
    """
    day = F.make_date(F.lit(origin), F.lit(12), F.lit(31))
    freq = yearly.filter(F.col("year") <= origin).groupBy("cand").agg(F.sum("n_papers").alias("df")).filter(F.col("df") >= min_df)
    alive = checkpoint(kill_reasons(freq, dominant_pos(counts, origin)).filter("kill_reason = 'keep'").drop("kill_reason"))
    valued = c_value(alive).select("cand", "c_value")
    merged = merge_map.filter(F.col("effective_date") <= day).select("cand", "cluster")
    labels = alive.select(F.col("cand").alias("cluster")).withColumn("alive", F.lit(True))
    mapped = valued.join(merged, "cand", "left").join(labels, "cluster", "left")
    mapped = mapped.select("cand", "c_value", F.when(F.col("alive"), F.col("cluster")).otherwise(F.col("cand")).alias("cluster"))
    if dropped is not None:
        mapped = mapped.join(dropped.select(F.col("term").alias("cluster")), "cluster", "left_anti")
    seen = postings.filter(F.col("v1_date") <= day).join(mapped, "cand")
    out = seen.groupBy("cluster").agg(F.countDistinct("id").alias("df_t"), F.countDistinct("cand").alias("n_members"), F.max("c_value").alias("c_value"), F.min("v1_date").alias("first_date"))
    return out.filter(F.col("c_value") > floor)
