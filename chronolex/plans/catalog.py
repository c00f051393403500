"""Registered queries of the corpus-mining operators, each with the SQL that it equals where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import stats, text
from chronolex.operators import attach, corpus, evaluate, features, graph, judge, merges, models, registry, structure, termhood
from chronolex.operators.components import checkpoint, label_components
from chronolex.plans.baskets import BEFORE, ORIGIN, Baskets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CTE = {
    "pp": "SELECT o_orderkey AS paper_id, CAST(o_orderdate AS DATE) AS v1_date, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, o_custkey FROM orders",
    "lt": "SELECT DISTINCT l_orderkey AS paper_id, unnest([p_name, p_name || ' ' || lower(p_type), split_part(p_name, ' ', 2)]) AS term FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ev": "SELECT paper_id, term, v1_date, year, quarter FROM lt JOIN pp USING (paper_id)",
    "au": "SELECT paper_id, 'c' || o_custkey AS author FROM pp UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem",
    "mm": """SELECT cand, CASE WHEN length(cand) - length(replace(cand, ' ', '')) = 2 THEN regexp_replace(cand, ' (economy|small)$', '') ELSE cand END AS cluster,
        CASE WHEN cand LIKE '% economy' THEN DATE '1998-06-30' ELSE DATE '1900-01-01' END AS effective_date FROM (SELECT DISTINCT term AS cand FROM lt)""",
    "ky": "SELECT greatest(5, count(*) // 600) AS k FROM orders",
    "ce": "SELECT paper_id, v1_date, year, quarter, CASE WHEN effective_date <= make_date(year, 12, 31) THEN cluster ELSE term END AS concept FROM ev JOIN mm ON cand = term",
    "ser": "SELECT concept, year, count(DISTINCT paper_id) AS n_papers FROM ce GROUP BY ALL",
    "fw": "SELECT a.concept, a.year AS t FROM ser a JOIN ser b ON a.concept = b.concept AND b.year = a.year + 1, ky WHERE a.n_papers >= k AND b.n_papers >= k AND a.year <= 1999",
    "cry": "SELECT concept, min(t) AS crystallization_year FROM fw GROUP BY 1",
    "dec": """SELECT concept, min(t) AS decline_year FROM cry, range(1995, 2000) r(t) WHERE t >= crystallization_year + 2
        AND NOT EXISTS (SELECT 1 FROM ser s, ky WHERE s.concept = cry.concept AND s.year IN (t, t + 1) AND n_papers >= k) GROUP BY 1""",
    "cens": "SELECT concept FROM ser, ky WHERE year = 2000 AND n_papers >= k AND concept NOT IN (SELECT concept FROM fw)",
    "lb": "SELECT paper_id, term AS concept, v1_date, year, quarter FROM ev WHERE length(term) - length(replace(term, ' ', '')) = 2",
    "bk": "SELECT DISTINCT split_part(concept, ' ', 2) AS region_id, concept AS node FROM lb",
    "two": "SELECT region_id, node FROM bk UNION ALL SELECT 'x ' || split_part(node, ' ', 1), node FROM bk",
    "ve": "SELECT node, embedding AS vec FROM (SELECT p_name || ' ' || lower(p_type) AS node, min(p_partkey) AS pk FROM part GROUP BY 1) JOIN embeddings ON vec_id = pk % (SELECT count(*) FROM embeddings)",
    "ls": "SELECT concept, year, count(DISTINCT paper_id) AS n FROM lb GROUP BY ALL",
    "lw": "SELECT a.concept, min(a.year) AS t FROM ls a JOIN ls b ON a.concept = b.concept AND b.year = a.year + 1, ky WHERE a.n >= k AND b.n >= k AND a.year <= 1999 GROUP BY 1",
    "bt": "SELECT concept, min(year) AS coinage_year, any_value(t) AS cry FROM ls LEFT JOIN lw USING (concept) GROUP BY 1",
    "dc": r"SELECT doc_id AS id, DATE '2016-01-01' + CAST(doc_id % 3650 AS INT) AS v1_date, [{lemma} for x in regexp_extract_all(lower(translate(text, '‐‑‒–—−', '------')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*(?:[-''’][\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*){{0,30}}|[^\p{{L}}\p{{N}}\p{{M}}\p{{Z}}\p{{C}}]')] AS words FROM documents",
    "tk": "SELECT id, v1_date, unnest(words) AS lemma, unnest(range(1, len(words) + 1)) AS i FROM dc",
    "tg": "SELECT *, CASE {tag} END AS pos FROM tk",
    "nl": r"SELECT id, v1_date, [CASE WHEN regexp_matches(x, '[\p{L}\p{N}]') THEN x END for x in words] AS w FROM dc",
    "g1": r"SELECT * FROM (SELECT id, v1_date, unnest(list_distinct(w)) AS cand FROM nl) WHERE regexp_matches(cand, '\p{L}')",
    "g2": r"SELECT * FROM (SELECT id, v1_date, unnest(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS cand FROM nl) WHERE regexp_matches(cand, '\p{L}')",
    "g3": r"SELECT * FROM (SELECT id, v1_date, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS cand FROM nl) WHERE regexp_matches(cand, '\p{L}')",
    "g4": r"SELECT * FROM (SELECT id, v1_date, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)])) AS cand FROM nl) WHERE regexp_matches(cand, '\p{L}')",
    "g5": r"SELECT * FROM (SELECT id, v1_date, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] for i in range(1, len(w) - 3)])) AS cand FROM nl) WHERE regexp_matches(cand, '\p{L}')",
    "po": "SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3",
    "tm": "SELECT cand, count(*) AS df FROM po GROUP BY 1 HAVING count(*) >= 9",
    "dp": """SELECT lemma, max_by(pos, (n, pos)) AS dominant_pos, sum(n)::BIGINT AS n_tokens, max(n)::DOUBLE / sum(n) AS dominance
        FROM (SELECT lemma, pos, count(*) AS n FROM tg GROUP BY ALL) GROUP BY 1""",
    "rk": r"SELECT DISTINCT id, cand FROM (SELECT id, string_agg(lemma, ' ' ORDER BY i) AS cand, count(*) AS n FROM (SELECT *, sum(stops::INT) OVER (PARTITION BY id ORDER BY i) AS grp FROM (SELECT *, lemma IN ({stop}) OR NOT regexp_matches(lemma, '[\p{{L}}\p{{N}}]') AS stops FROM tk)) WHERE NOT stops GROUP BY id, grp) WHERE n <= 5",
    "ch": """SELECT DISTINCT id, array_to_string(l[len(l) - n + 1:], ' ') AS cand FROM (SELECT id, l, unnest(range(1, least(5, len(l)) + 1)) AS n FROM (SELECT id, list(lemma ORDER BY i) AS l FROM
        (SELECT *, sum(((pos NOT IN ('NOUN', 'ADJ')) OR (pos = 'ADJ' AND before = 'NOUN'))::INT) OVER (PARTITION BY id ORDER BY i) AS grp FROM (SELECT *, lag(pos, 1, '') OVER (PARTITION BY id ORDER BY i) AS before FROM tg)) WHERE pos IN ('NOUN', 'ADJ') GROUP BY id, grp HAVING bool_or(pos = 'NOUN')))""",
    "mk": r"SELECT cand, bit_or(m)::INT AS src_mask FROM (SELECT cand, 1 AS m FROM rk UNION ALL SELECT cand, 2 FROM ch) WHERE regexp_matches(cand, '\p{L}') GROUP BY 1",
    "no": "SELECT * FROM mk WHERE length(cand) - length(replace(cand, ' ', '')) NOT IN (1, 2)",
    "ab": """SELECT id, v1_date, cand, 4 AS own FROM g2 UNION ALL SELECT id, v1_date, cand, 4 FROM g3
        UNION ALL SELECT id, v1_date, cand, 0 FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5) WHERE cand IN (SELECT cand FROM no)""",
}
#: Tables that are read more than once.
KEPT = {"dc", "tk", "tg", "nl", "po", "tm", "dp", "mk", "no", "cry", "ser", "fw", "ce", "lb", "wp", "cp", "pr", "eg", "bn", "pf", "att"}
_STOP = ", ".join("'" + w + "'" for w in sorted(text.STOPWORDS))
_GENERIC = ", ".join(f"'{w}'" for w in sorted(termhood.GENERIC))
_LEMMA = f"""CASE WHEN x IN ({_STOP}) OR length(x) < 4 OR NOT suffix(x, 's') OR regexp_matches(x, '(ss|us|is|''s|’s)$') THEN x WHEN length(x) > 4 AND suffix(x, 'ies') THEN left(x, length(x) - 3) || 'y'
    WHEN length(x) > 4 AND regexp_matches(x, '(sses|xes|zes|ches|shes)$') THEN left(x, length(x) - 2) ELSE left(x, length(x) - 1) END"""
_TAG = rf"""WHEN NOT regexp_matches(lemma, '[\p{{L}}\p{{N}}]') THEN 'PUNCT' WHEN lemma IN ({_STOP}) THEN 'DET' WHEN NOT regexp_matches(lemma, '\p{{L}}') THEN 'NUM' WHEN regexp_matches(lemma, '(ly)$') THEN 'ADV'
    WHEN regexp_matches(lemma, '(ing|ed)$') THEN CASE WHEN contains(lemma, '-') THEN 'ADJ' ELSE 'VERB' END WHEN regexp_matches(lemma, '(ous|ive|al|ble)$') THEN 'ADJ' ELSE 'NOUN'"""
CTE |= {"dc": CTE["dc"].format(lemma=_LEMMA), "tg": CTE["tg"].format(tag=_TAG), "rk": CTE["rk"].format(stop=_STOP)}


def window_ctes(origin: int, events: str = "lb", cap: int = 25) -> dict[str, str]:
    """Projection of the window that ends with a year: wp, cp, pr, eg (edges)."""
    return {
        "wp": f"SELECT DISTINCT paper_id, concept FROM {events} WHERE year BETWEEN {origin - 2} AND {origin}",
        "wd": "SELECT concept, count(*) AS df FROM wp GROUP BY 1",
        "cp": f"SELECT paper_id, concept FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY df, concept) AS r FROM wp JOIN wd USING (concept)) WHERE r <= {cap}",
        "pr": """SELECT paper_id, u, v, 1.0 / count(*) OVER (PARTITION BY paper_id) AS share FROM (SELECT a.paper_id, a.concept AS u, b.concept AS v FROM cp a JOIN cp b ON a.paper_id = b.paper_id AND a.concept < b.concept)
            WHERE instr(' ' || u || ' ', ' ' || v || ' ') = 0 AND instr(' ' || v || ' ', ' ' || u || ' ') = 0""",
        "eg": """SELECT u, v, weight, n_papers, n_papers * (SELECT count(DISTINCT paper_id) FROM wp)::DOUBLE / (a.df * b.df) AS lift
            FROM (SELECT u, v, sum(share) AS weight, count(*) AS n_papers FROM pr GROUP BY ALL) JOIN wd a ON a.concept = u JOIN wd b ON b.concept = v""",
        "bn": "SELECT u, v FROM eg WHERE n_papers >= 4 AND lift >= 2.0",
    }


#: What each common table needs before it.
ORDER = list(CTE)


def with_(body: str, names: str = "", extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    parts = {n: CTE[n] for n in ORDER if n in names.split()} | (extra or {})
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({q})" for n, q in parts.items()) + " " + body if parts else body


BASE, SERIES = "pp lt ev mm ky ce ser", "pp lt ev mm ky ce ser fw"
DOCS, TERMS = "dc tk", "dc nl g1 g2 g3 po tm"
MASKS = "dc tk tg rk ch mk"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Baskets], DataFrame]], Callable[[Baskets], DataFrame]]:
    def register(build: Callable[[Baskets], DataFrame]) -> Callable[[Baskets], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Baskets(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- registry ---------------------------------------------------------------------------------------------------------


@query("concept_year_series", with_("SELECT * FROM ser", BASE))
def _(b: Baskets) -> DataFrame:
    return registry.series(b.concepts())


@query("merge_asof_resolve", with_("""SELECT concept, count(DISTINCT paper_id) AS n_papers FROM (SELECT paper_id, CASE WHEN effective_date <= DATE '1997-12-31' THEN cluster ELSE term END AS concept
    FROM ev JOIN mm ON cand = term WHERE year <= 1997) GROUP BY 1""", "pp lt ev mm"))
def _(b: Baskets) -> DataFrame:
    return b.concepts("origin", BEFORE).filter(F.col("year") <= BEFORE).groupBy("concept").agg(F.countDistinct("paper_id").alias("n_papers"))


@query("merge_day_resolve", with_("""SELECT concept, count(DISTINCT paper_id) AS n_papers FROM (SELECT paper_id, CASE WHEN effective_date <= v1_date THEN cluster ELSE term END AS concept FROM ev JOIN mm ON cand = term) GROUP BY 1""", "pp lt ev mm"))
def _(b: Baskets) -> DataFrame:
    return b.concepts("day").groupBy("concept").agg(F.countDistinct("paper_id").alias("n_papers"))


@query("crystallization_windows", with_("SELECT * FROM fw", SERIES))
def _(b: Baskets) -> DataFrame:
    return b.windows


@query("births_per_year", with_("SELECT crystallization_year, count(*) AS n_births FROM cry GROUP BY 1", SERIES + " cry"))
def births_per_year(b: Baskets) -> DataFrame:
    return registry.births_per_year(b.cry)


@query("decline_year", with_("SELECT concept, decline_year::INT AS decline_year FROM dec", SERIES + " cry dec"))
def _(b: Baskets) -> DataFrame:
    return registry.declines(b.series, b.cry, b.cfg)


@query("censoring", with_("SELECT concept FROM cens", SERIES + " cens"))
def _(b: Baskets) -> DataFrame:
    return registry.censored_concepts(b.series, b.windows, b.cfg)


@query("coinage_min_member", with_("SELECT cluster AS concept, min(v1_date) AS coinage_date, count(DISTINCT term) AS n_members FROM ev JOIN mm ON cand = term GROUP BY 1", "pp lt ev mm"))
def _(b: Baskets) -> DataFrame:
    return b.members.groupBy("concept").agg(F.min("first_date").alias("coinage_date"), F.countDistinct("term").alias("n_members"))


_REG = """reg AS (SELECT s.concept, crystallization_year, decline_year, CASE WHEN crystallization_year IS NULL THEN CASE WHEN concept IN (SELECT concept FROM cens) THEN 'censored' ELSE 'coinage_only' END
    WHEN decline_year IS NOT NULL THEN 'crystallized_then_declined' ELSE 'persisted' END AS fate, peak_year, peak_papers, total_papers
    FROM (SELECT concept, arg_max(year, (n_papers, -year)) AS peak_year, max(n_papers) AS peak_papers, sum(n_papers)::BIGINT AS total_papers FROM ser WHERE year <= 2000 GROUP BY 1) s LEFT JOIN cry USING (concept) LEFT JOIN dec USING (concept))"""


@query("birth_fate", with_("SELECT * FROM (", SERIES + " cry dec cens").removesuffix(" SELECT * FROM (") + ", " + _REG + " SELECT concept, crystallization_year, decline_year::INT AS decline_year, fate, peak_year, peak_papers, total_papers FROM reg")
def _(b: Baskets) -> DataFrame:
    return b.registry.select("concept", "crystallization_year", "decline_year", "fate", "peak_year", "peak_papers", "total_papers")


@query("power_gate", with_("SELECT o.origin::INT AS origin, count(concept) AS n_births, count(concept) < 10 AS too_few FROM range(1996, 1999) o(origin) LEFT JOIN cry ON crystallization_year = o.origin + 1 GROUP BY 1", SERIES + " cry"))
def _(b: Baskets) -> DataFrame:
    return registry.power_gate(b.cry, [1996, 1997, 1998], 10)


_GROUPS = {
    "gp": "SELECT DISTINCT fw.concept, fw.t, ce.paper_id FROM fw JOIN ce ON ce.concept = fw.concept AND ce.year IN (fw.t, fw.t + 1)",
    "ga": "SELECT concept, t, paper_id, author FROM gp JOIN au USING (paper_id)",
    "gs": "SELECT DISTINCT x.concept, x.t, x.author AS s, y.author AS hub FROM ga x JOIN ga y USING (concept, t, paper_id) WHERE x.author LIKE 's%' AND y.author LIKE 'c%'",
    "ge": "SELECT DISTINCT concept, t, s AS a, min(s) OVER (PARTITION BY concept, t, hub) AS b FROM gs",
    "gb": "SELECT concept, t, a, b FROM ge UNION SELECT concept, t, b, a FROM ge",
    "gr": "SELECT concept, t, a AS node, a AS o FROM gb UNION SELECT gr.concept, gr.t, gr.node, gb.b FROM gr JOIN gb ON gb.concept = gr.concept AND gb.t = gr.t AND gb.a = gr.o",
}


# Every paper has a buyer and suppliers, so suppliers that share a buyer are linked, and components of suppliers are those of papers.
@query("author_groups", with_("SELECT concept, t, count(DISTINCT root)::INT AS n_groups FROM (SELECT concept, t, node, min(o) AS root FROM gr GROUP BY ALL) GROUP BY ALL", SERIES + " au", _GROUPS, recursive=True))
def _(b: Baskets) -> DataFrame:
    return registry.author_groups(b.windows, b.resolved, b.authors, b.cfg)


_NATIONS = {
    "na": "SELECT o_orderkey AS paper_id, c_nationkey AS author FROM orders JOIN customer ON c_custkey = o_custkey",
    "ng": "SELECT fw.concept, fw.t, count(DISTINCT author) AS g FROM fw JOIN ce ON ce.concept = fw.concept AND ce.year IN (fw.t, fw.t + 1) JOIN na USING (paper_id) GROUP BY ALL",
    "nc": "SELECT concept, min(t) AS t FROM ng WHERE g >= 23 GROUP BY 1",
}


@query("births_by_nations", with_("SELECT concept, nc.t AS crystallization_year, g::INT AS n_author_groups FROM nc JOIN ng USING (concept, t)", SERIES, _NATIONS))
def _(b: Baskets) -> DataFrame:
    nations = b.papers.select("paper_id", F.col("o_custkey").alias("c_custkey")).join(b.read("customer").select("c_custkey", F.col("c_nationkey").alias("author")), "c_custkey")
    cfg = b.cfg.with_(min_groups=23)
    return registry.crystallizations(b.windows, registry.author_groups(b.windows, b.resolved, nations, cfg), cfg)


# --- graph ------------------------------------------------------------------------------------------------------------


@query("event_store", with_("SELECT paper_id, term, v1_date, year FROM ev WHERE term IN (SELECT term FROM ev GROUP BY 1 HAVING count(*) > 50) AND term NOT LIKE 'red %'", "pp lt ev"))
def _(b: Baskets) -> DataFrame:
    values = b.events.groupBy(F.col("term").alias("cand")).agg((F.count(F.lit(1)) - 50).alias("c_value"))
    verdicts = b.merge_map.filter("cand like 'red %'").select(F.col("cand").alias("term"), F.lit("DROP").alias("verdict"))
    return graph.event_store(b.events, values, verdicts)


@query("fractional_projection", with_("SELECT u, v, round(weight, 6) AS weight, n_papers FROM eg", "pp lt ev", window_ctes(ORIGIN, "(SELECT *, term AS concept FROM ev)")))
def _(b: Baskets) -> DataFrame:
    return graph.project(b.events.withColumnRenamed("term", "concept"), ORIGIN, b.cfg).select("u", "v", *r6("weight"), "n_papers")


@query("capped_projection", with_("SELECT u, v, round(weight, 6) AS weight, n_papers, round(lift, 6) AS lift FROM eg", "pp lt ev", window_ctes(ORIGIN, "(SELECT *, term AS concept FROM ev)", 5)))
def _(b: Baskets) -> DataFrame:
    return graph.project(b.events.withColumnRenamed("term", "concept"), ORIGIN, b.cfg.with_(cap=5)).select("u", "v", *r6("weight"), "n_papers", *r6("lift"))


@query("edge_lift", with_("SELECT u, v, n_papers, round(lift, 6) AS lift FROM eg", "pp lt ev lb", window_ctes(ORIGIN)))
def _(b: Baskets) -> DataFrame:
    return b.edges(ORIGIN).select("u", "v", "n_papers", *r6("lift"))


@query("binarised_edges", with_("SELECT * FROM bn", "pp lt ev lb", window_ctes(ORIGIN)))
def _(b: Baskets) -> DataFrame:
    return b.strong(ORIGIN)


@query("mass_invariant", with_("SELECT round(sum(share), 6) AS total_weight, count(DISTINCT paper_id) AS n_papers FROM pr", "pp lt ev", window_ctes(ORIGIN, "(SELECT *, term AS concept FROM ev)")))
def _(b: Baskets) -> DataFrame:
    return graph.mass(b.events.withColumnRenamed("term", "concept"), ORIGIN, b.cfg)


@query("triangle_join", with_("SELECT a.u, a.v, b.v AS w FROM bn a JOIN bn b ON a.v = b.u JOIN bn c ON c.u = a.u AND c.v = b.v", "pp lt ev lb", window_ctes(ORIGIN)))
def _(b: Baskets) -> DataFrame:
    return features.triangles(b.strong(ORIGIN))


def _percolation(origin: int, at: str = "") -> dict[str, str]:
    return window_ctes(origin) | {
        "tri": "SELECT a.u || chr(1) || a.v || chr(1) || b.v AS c, a.u, a.v, b.v AS w FROM bn a JOIN bn b ON a.v = b.u JOIN bn d ON d.u = a.u AND d.v = b.v",
        "face": "SELECT c, unnest([u || chr(1) || v, u || chr(1) || w, v || chr(1) || w]) AS f FROM tri",
        "lk": "SELECT DISTINCT x.c AS a, y.c AS b FROM face x JOIN face y USING (f)",
        "rc": "SELECT c AS a, c AS b FROM tri UNION SELECT rc.a, lk.b FROM rc JOIN lk ON rc.b = lk.a",
        "rt": "SELECT a AS c, min(b) AS root FROM rc GROUP BY 1",
        "rn": "SELECT DISTINCT root, unnest([u, v, w]) AS node FROM tri JOIN rt USING (c)",
    }


@query("k3_regions", with_("SELECT count(*) AS size, string_agg(node, '|' ORDER BY node) AS members FROM rn GROUP BY root", "pp lt ev lb", _percolation(ORIGIN), recursive=True))
def _(b: Baskets) -> DataFrame:
    return b.regions(ORIGIN).select("size", F.array_join("members", "|").alias("members"))


@query("guarded_regions")
def _(b: Baskets) -> DataFrame:
    found, least = graph.guarded_regions(b.edges(ORIGIN), 3, b.cfg.with_(binarize_papers=3, binarize_lift=1.5))
    return found.select("region_no", "size", F.array_join("members", "|").alias("members"), F.lit(least).alias("min_papers"))


@query("lineage_jaccard", with_("""SELECT region_id, CASE WHEN jaccard >= 0.3 THEN parent_id END AS parent_id, round(coalesce(jaccard, 0), 6) AS jaccard, CASE WHEN jaccard >= 0.3 THEN 'matched' ELSE 'born' END AS event
    FROM (SELECT DISTINCT region_id FROM cur) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY jaccard DESC, parent_id) AS r FROM
    (SELECT region_id, parent_id, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) AS jaccard FROM cur JOIN old USING (node) GROUP BY ALL)) USING (region_id) WHERE coalesce(r, 1) = 1""", "pp lt ev lb", {
    "cur": "SELECT concept AS node, split_part(concept, ' ', 2) AS region_id, count(*) OVER (PARTITION BY split_part(concept, ' ', 2)) AS na FROM (SELECT concept FROM lb WHERE year = 2000 GROUP BY 1 HAVING count(*) >= 15)",
    "old": "SELECT concept AS node, split_part(concept, ' ', 1) AS parent_id, count(*) OVER (PARTITION BY split_part(concept, ' ', 1)) AS nb FROM (SELECT concept FROM lb WHERE year = 1999 GROUP BY 1 HAVING count(*) >= 15)"}))
def _(b: Baskets) -> DataFrame:
    def at(year: int, word: int, name: str) -> DataFrame:
        often = b.labels.filter(F.col("year") == year).groupBy("concept").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")
        return often.groupBy(F.split("concept", " ")[word].alias(name)).agg(F.collect_list("concept").alias("members"))

    return graph.lineage(at(2000, 1, "region_id"), at(1999, 0, "region_id"), 0.3).select("region_id", "parent_id", *r6("jaccard"), "event")


_CLIQUES = {
    "k3": "SELECT a.u, a.v, b.v AS w FROM bn a JOIN bn b ON a.v = b.u JOIN bn c ON c.u = a.u AND c.v = b.v",
    "k4": "SELECT k3.*, d.v AS x FROM k3 JOIN bn d ON d.u = w WHERE (k3.u, d.v) IN (SELECT u, v FROM bn) AND (k3.v, d.v) IN (SELECT u, v FROM bn)",
    "k5": "SELECT k4.*, e.v AS y FROM k4 JOIN bn e ON e.u = x WHERE (k4.u, e.v) IN (SELECT u, v FROM bn) AND (k4.v, e.v) IN (SELECT u, v FROM bn) AND (k4.w, e.v) IN (SELECT u, v FROM bn)",
    "sb": "SELECT u, v FROM eg WHERE n_papers >= 3 AND lift >= 1.5",
}
_LOOSE_GRAPH = {n: q for n, q in window_ctes(ORIGIN).items()} | {"sb": _CLIQUES["sb"]} | {n: q.replace("bn", "sb") for n, q in _CLIQUES.items() if n != "sb"}


@query("clique_counts", with_("SELECT 3 AS k, count(*) AS n FROM k3 UNION ALL SELECT 4, count(*) FROM k4 UNION ALL SELECT 5, count(*) FROM k5", "pp lt ev lb", _LOOSE_GRAPH))
def _(b: Baskets) -> DataFrame:
    edges, out = graph.binarize(b.edges(ORIGIN), 3, 1.5), None
    for k in (3, 4, 5):
        one = graph.cliques(edges, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
        out = one if out is None else out.union(one)
    return out


_K4 = _LOOSE_GRAPH | {
    "qf": "SELECT u || chr(1) || v || chr(1) || w || chr(1) || x AS c, unnest([u || chr(1) || v || chr(1) || w, u || chr(1) || v || chr(1) || x, u || chr(1) || w || chr(1) || x, v || chr(1) || w || chr(1) || x]) AS f FROM k4",
    "qk": "SELECT DISTINCT c AS a, min(c) OVER (PARTITION BY f) AS b FROM qf",
    "qb": "SELECT a, b FROM qk UNION SELECT b, a FROM qk",
    "qr": "SELECT a, a AS o FROM qb UNION SELECT qr.a, qb.b FROM qr JOIN qb ON qr.o = qb.a",
    "qn": "SELECT DISTINCT root, unnest(string_split(c, chr(1))) AS node FROM (SELECT a AS c, min(o) AS root FROM qr GROUP BY 1)",
}


@query("k4_regions", with_("SELECT (row_number() OVER (ORDER BY size DESC, members) - 1)::INT AS region_no, size, replace(members, chr(1), '|') AS members FROM (SELECT count(*) AS size, string_agg(node, chr(1) ORDER BY node) AS members FROM qn GROUP BY root)", "pp lt ev lb", _K4, recursive=True))
def _(b: Baskets) -> DataFrame:
    return graph.regions(graph.binarize(b.edges(ORIGIN), 3, 1.5), 4).select("region_no", "size", F.array_join("members", "|").alias("members"))


@query("binarised_by_weight", with_("SELECT u, v FROM eg WHERE weight >= 0.9999999 AND lift >= 2.0", "pp lt ev lb", window_ctes(ORIGIN)))
def _(b: Baskets) -> DataFrame:
    return graph.binarize(b.edges(ORIGIN).withColumn("weight", F.round("weight", 9)), 0, 2.0, "weight")


@query("graph_stats", with_("SELECT (SELECT count(*) FROM eg) AS edges_weighted, (SELECT count(*) FROM (SELECT u FROM eg UNION SELECT v FROM eg)) AS nodes_in_graph, (SELECT count(*) FROM bn) AS edges_binarized, (SELECT count(*) FROM (SELECT u FROM bn UNION SELECT v FROM bn)) AS nodes_binarized", "pp lt ev lb", window_ctes(ORIGIN)))
def _(b: Baskets) -> DataFrame:
    return graph.graph_stats(b.edges(ORIGIN), b.cfg)


_TIMES = {
    "cur": "SELECT concept AS node, split_part(concept, ' ', 2) AS region_id, count(*) OVER (PARTITION BY split_part(concept, ' ', 2)) AS na FROM (SELECT concept FROM lb WHERE year = 2000 GROUP BY 1 HAVING count(*) >= 15)",
    "old": "SELECT concept AS node, split_part(concept, ' ', 1) AS parent_id, count(*) OVER (PARTITION BY split_part(concept, ' ', 1)) AS nb FROM (SELECT concept FROM lb WHERE year = 1999 GROUP BY 1 HAVING count(*) >= 15)",
    "lj": "SELECT region_id, arg_max(parent_id, (jaccard, -ascii(parent_id))) AS p, max(jaccard) AS j FROM (SELECT region_id, parent_id, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) AS jaccard FROM cur JOIN old USING (node) GROUP BY ALL) GROUP BY 1",
    "li": "SELECT region_id, CASE WHEN j >= 0.02 THEN p END AS parent_id FROM (SELECT DISTINCT region_id FROM cur) LEFT JOIN lj USING (region_id)",
}


def _at(b: Baskets, year: int, word: int, name: str) -> DataFrame:
    often = b.labels.filter(F.col("year") == year).groupBy("concept").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")
    return often.groupBy(F.split("concept", " ")[word].alias(name)).agg(F.collect_list("concept").alias("members"))


@query("lineage_stats", with_("""SELECT count(parent_id) AS n_matched, count(*) - count(parent_id) AS n_born, (SELECT count(*) FROM (SELECT parent_id FROM li WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_splits,
    (SELECT count(*) FROM (SELECT DISTINCT parent_id FROM old) WHERE parent_id NOT IN (SELECT parent_id FROM li WHERE parent_id IS NOT NULL)) AS n_died FROM li""", "pp lt ev lb", _TIMES))
def _(b: Baskets) -> DataFrame:
    before = _at(b, 1999, 0, "region_id")
    return graph.lineage_stats(graph.lineage(_at(b, 2000, 1, "region_id"), before, 0.02), before)


# --- units ------------------------------------------------------------------------------------------------------------

_TOUCH = {"tp": "SELECT DISTINCT region_id, paper_id, year, quarter FROM bk JOIN lb ON node = concept"}


@query("region_exposure", with_("""SELECT region_id, n_t, n_t1, n_t2, n_t AS exposure, round(n_t / greatest(1, n_t1), 6) AS paper_velocity_1y, round(n_t / greatest(1.0, (n_t1 + n_t2) / 2), 6) AS paper_velocity_2y
    FROM (SELECT region_id, count(*) FILTER (year = 2000) AS n_t, count(*) FILTER (year = 1999) AS n_t1, count(*) FILTER (year = 1998) AS n_t2 FROM tp GROUP BY 1)""", "pp lt ev lb bk", _TOUCH))
def _(b: Baskets) -> DataFrame:
    return features.exposure(b.blocks(), b.labels, ORIGIN).select("region_id", "n_t", "n_t1", "n_t2", "exposure", *r6("paper_velocity_1y", "paper_velocity_2y"))


@query("yoy_quarter_accel", with_("""SELECT region_id, round(avg(a / greatest(1.0, p) - p / greatest(1.0, pp)), 6) AS yoy_quarter_accel, false AS yoy_missing FROM
    (SELECT region_id, q, count(*) FILTER (year = 2000 AND quarter = q)::DOUBLE AS a, count(*) FILTER (year = 1999 AND quarter = q)::DOUBLE AS p, count(*) FILTER (year = 1998 AND quarter = q)::DOUBLE AS pp FROM tp, range(1, 5) t(q) GROUP BY ALL) GROUP BY 1""", "pp lt ev lb bk", _TOUCH))
def _(b: Baskets) -> DataFrame:
    return features.quarter_acceleration(b.blocks(), b.labels, ORIGIN).select("region_id", *r6("yoy_quarter_accel"), "yoy_missing")


_INNER = {"inn": "SELECT x.region_id, u, v FROM bn JOIN bk x ON x.node = u JOIN bk y ON y.node = v AND x.region_id = y.region_id"}


@query("region_density", with_("""SELECT region_id, size, e AS edges_internal, round(CASE WHEN size > 2 THEN 2.0 * e / (size * (size - 1)) END, 6) AS density FROM
    (SELECT region_id, count(*) AS size, (SELECT count(*) FROM inn WHERE inn.region_id = bk.region_id) AS e FROM bk GROUP BY 1)""", "pp lt ev lb bk", window_ctes(ORIGIN) | _INNER))
def _(b: Baskets) -> DataFrame:
    return features.density(b.blocks(), b.strong(ORIGIN)).select("region_id", "size", "edges_internal", *r6("density"))


_INNER_PAST = {n + "1": q.replace(" wp", " wp1").replace("FROM wp)", "FROM wp1)").replace(" wd", " wd1").replace(" cp", " cp1").replace(" pr", " pr1").replace(" eg", " eg1") for n, q in window_ctes(ORIGIN - 1).items()} | {
    "inn1": "SELECT x.region_id, u, v FROM bn1 JOIN bk x ON x.node = u JOIN bk y ON y.node = v AND x.region_id = y.region_id"}


@query("edge_velocity", with_("""SELECT region_id, round(CASE WHEN region_id >= 'g' THEN e0 / greatest(1.0, e1) END, 6) AS edge_velocity, round(CASE WHEN region_id >= 'g' AND size > 2 THEN 2.0 * (e0 - e1) / (size * (size - 1)) END, 6) AS density_change, region_id < 'g' AS graph_delta_missing, region_id >= 'g' AS has_lineage_parent
    FROM (SELECT region_id, count(*) AS size, (SELECT count(*) FROM inn WHERE inn.region_id = bk.region_id) AS e0, (SELECT count(*) FROM inn1 WHERE inn1.region_id = bk.region_id) AS e1 FROM bk GROUP BY 1)""", "pp lt ev lb bk", window_ctes(ORIGIN) | _INNER | _INNER_PAST))
def _(b: Baskets) -> DataFrame:
    lines = b.blocks().select("region_id").distinct().withColumn("event", F.when(F.col("region_id") < "g", "born").otherwise("matched"))
    out = features.edge_velocity(b.blocks(), b.strong(ORIGIN), b.strong(ORIGIN - 1), lines)
    return out.select("region_id", *r6("edge_velocity", "density_change"), "graph_delta_missing", "has_lineage_parent")


_PACE = {
    "jp": "SELECT DISTINCT i.u, i.v, a.paper_id, y.year FROM (SELECT DISTINCT u, v FROM inn) i JOIN wp a ON a.concept = i.u JOIN wp b ON b.concept = i.v AND b.paper_id = a.paper_id JOIN pp y ON y.paper_id = a.paper_id",
    "ra": "SELECT u, v, count(*)::DOUBLE / (max(year) - min(year) + 1) AS pace FROM jp GROUP BY ALL",
    "ja": "SELECT u, v, paper_id, author FROM jp JOIN au USING (paper_id)",
    "je": "SELECT DISTINCT u, v, paper_id AS a, min(paper_id) OVER (PARTITION BY u, v, author) AS b FROM ja",
    "jb": "SELECT u, v, a, b FROM je UNION SELECT u, v, b, a FROM je",
    "jr": "SELECT u, v, a AS node, a AS o FROM jb UNION SELECT jr.u, jr.v, jr.node, jb.b FROM jr JOIN jb ON jb.u = jr.u AND jb.v = jr.v AND jb.a = jr.o",
    "br": "SELECT u, v, count(DISTINCT root) AS n_groups FROM (SELECT u, v, node, min(o) AS root FROM jr GROUP BY ALL) GROUP BY ALL",
}


@query("pace_breadth", with_("SELECT region_id, round(median(pace), 6) AS pace_collaboration, median(n_groups)::DOUBLE AS social_breadth, median(pace) IS NULL AS pace_missing FROM (SELECT DISTINCT region_id FROM bk) LEFT JOIN (SELECT region_id, pace, n_groups FROM inn JOIN ra USING (u, v) JOIN br USING (u, v)) USING (region_id) GROUP BY 1", "pp lt ev au lb bk", window_ctes(ORIGIN) | _INNER | _PACE, recursive=True))
def _(b: Baskets) -> DataFrame:
    return features.pace(b.blocks(), b.strong(ORIGIN), b.labels, b.authors, ORIGIN).select("region_id", *r6("pace_collaboration"), "social_breadth", "pace_missing")


@query("author_influx", with_("""SELECT region_id, round(CASE WHEN sum(now) > 0 THEN sum(now * (1 - past))::DOUBLE / sum(now) END, 6) AS author_influx FROM
    (SELECT region_id, author, max((year = 2000)::INT) AS now, max((year < 2000)::INT) AS past FROM tp JOIN au USING (paper_id) WHERE year BETWEEN 1998 AND 2000 GROUP BY ALL) GROUP BY 1""", "pp lt ev au lb bk", _TOUCH))
def _(b: Baskets) -> DataFrame:
    return features.author_influx(features.touching(b.blocks(), b.labels), b.authors, "region_id", ORIGIN).select("region_id", *r6("author_influx"))


_CEN = {"ex": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings", "cen": "SELECT label, d, avg(x) AS c, count(*) AS n FROM ex GROUP BY ALL"}


@query("embedding_spread", with_("""SELECT label, count(*) AS n_vectors, round(CASE WHEN count(*) >= 3 THEN avg(1 - cosine) END, 5) AS embedding_spread FROM
    (SELECT vec_id, label, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM ex JOIN cen USING (label, d) GROUP BY ALL) GROUP BY 1""", "", _CEN))
def _(b: Baskets) -> DataFrame:
    vectors = b.read("embeddings").select("label", F.col("embedding").alias("vec"))
    return features.embedding_spread(vectors, "label").select("label", "n_vectors", F.round("embedding_spread", 5).alias("embedding_spread"))


@query("centroid_distance", with_("""SELECT p.label AS a, q.label AS b, round(1 - sum(p.c * q.c) / (sqrt(sum(p.c * p.c)) * sqrt(sum(q.c * q.c))), 5) AS centroid_distance FROM cen p JOIN cen q ON p.d = q.d AND q.label IN (p.label + 1, p.label + 2) WHERE p.n >= 3 AND q.n >= 3 GROUP BY ALL""", "", _CEN))
def _(b: Baskets) -> DataFrame:
    vectors = b.read("embeddings").select("label", F.col("embedding").alias("vec"))
    labels = vectors.select("label").distinct()
    pairs = labels.select(F.col("label").alias("a"), F.explode(F.array(F.col("label") + 1, F.col("label") + 2)).alias("b"))
    return features.centroid_distances(vectors, "label", pairs).select("a", "b", F.round("centroid_distance", 5).alias("centroid_distance"))


_NODE_VECTORS = {
    "nx": "SELECT region_id, node, unnest(vec)::DOUBLE AS x, unnest(range(1, len(vec) + 1)) AS d FROM two JOIN ve USING (node)",
    "nc": "SELECT region_id, d, avg(x) AS c, count(*) AS n FROM nx GROUP BY ALL",
    "nd": "SELECT region_id, node, 1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS dist, any_value(n) AS n FROM nx JOIN nc USING (region_id, d) GROUP BY ALL",
}
_BRIDGES = {
    "b0": "SELECT least(x.region_id, y.region_id) AS a, greatest(x.region_id, y.region_id) AS b, count(DISTINCT (u, v)) AS n FROM bn JOIN two x ON x.node = u JOIN two y ON y.node = v AND x.region_id <> y.region_id GROUP BY ALL",
    "b1": "SELECT least(x.region_id, y.region_id) AS a, greatest(x.region_id, y.region_id) AS b, count(DISTINCT (u, v)) AS n FROM bn1 JOIN two x ON x.node = u JOIN two y ON y.node = v AND x.region_id <> y.region_id GROUP BY ALL",
    "sz": "SELECT region_id, count(*) AS n FROM two GROUP BY 1",
    "t3": "SELECT DISTINCT region_id, paper_id FROM two JOIN lb ON node = concept WHERE year BETWEEN 1998 AND 2000",
    "dp2": "SELECT x.region_id AS a, y.region_id AS b, count(*) AS n FROM t3 x JOIN t3 y ON x.paper_id = y.paper_id AND x.region_id < y.region_id GROUP BY ALL",
    "dn": "SELECT x.region_id AS a, y.region_id AS b, count(*) AS n FROM two x JOIN two y ON x.node = y.node AND x.region_id < y.region_id GROUP BY ALL",
}


@query("bridge_mass", with_("SELECT a, b, n AS bridge_mass FROM b0", "pp lt ev lb bk two", window_ctes(ORIGIN) | {"b0": _BRIDGES["b0"]}))
def _(b: Baskets) -> DataFrame:
    return features.bridges(b.two(), b.strong(ORIGIN))


@query("dual_papers", with_("SELECT b0.a, b0.b, coalesce(dn.n, 0) AS dual_citizens, coalesce(dp2.n, 0) AS dual_papers FROM b0 LEFT JOIN dn USING (a, b) LEFT JOIN dp2 USING (a, b)", "pp lt ev lb bk two", window_ctes(ORIGIN) | {n: q for n, q in _BRIDGES.items() if n != "b1"}))
def _(b: Baskets) -> DataFrame:
    return features.dual_papers(b.two(), features.bridges(b.two(), b.strong(ORIGIN)), b.labels, ORIGIN)


@query("pair_features", with_("""SELECT a, b, x.n AS size_a, y.n AS size_b, b0.n AS bridge_mass, b1.n AS bridge_mass_prev, round(b0.n / greatest(1.0, b1.n), 6) * CASE WHEN b1.n IS NULL THEN NULL ELSE 1 END AS bridge_growth, b1.n IS NULL AS bridge_growth_missing, coalesce(dn.n, 0) AS dual_citizens,
    coalesce(dp2.n, 0) AS dual_papers, round(dist, 5) AS centroid_distance, dist IS NULL AS centroid_distance_missing FROM b0 LEFT JOIN b1 USING (a, b) JOIN sz x ON x.region_id = a JOIN sz y ON y.region_id = b LEFT JOIN dn USING (a, b) LEFT JOIN dp2 USING (a, b)
    LEFT JOIN (SELECT p.region_id AS a, q.region_id AS b, 1 - sum(p.c * q.c) / (sqrt(sum(p.c * p.c)) * sqrt(sum(q.c * q.c))) AS dist FROM nc p JOIN nc q ON p.d = q.d AND p.region_id < q.region_id WHERE p.n >= 3 AND q.n >= 3 GROUP BY ALL) USING (a, b)""",
    "pp lt ev lb bk two ve", window_ctes(ORIGIN) | {n: q for n, q in _INNER_PAST.items() if n != "inn1"} | _BRIDGES | _NODE_VECTORS))
def _(b: Baskets) -> DataFrame:
    out = features.pair_features(b.two(), b.strong(ORIGIN), b.strong(ORIGIN - 1), b.labels, b.vectors, ORIGIN)
    return out.withColumns({"bridge_growth": F.round("bridge_growth", 6), "centroid_distance": F.round("centroid_distance", 5)})


@query("embedding_influx", with_("""SELECT region_id, round(s0, 5) AS embedding_spread, round(s0 - s1, 5) AS embedding_influx, s0 - s1 IS NULL AS embedding_missing FROM (SELECT DISTINCT region_id FROM cur) LEFT JOIN (SELECT region_id, avg(1 - cosine) AS s0 FROM (SELECT region_id, node, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM cx JOIN cc USING (region_id, d) GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 3) USING (region_id)
    LEFT JOIN li USING (region_id) LEFT JOIN (SELECT parent_id, avg(1 - cosine) AS s1 FROM (SELECT parent_id, node, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM ox JOIN oc USING (parent_id, d) GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 3) USING (parent_id)""", "pp lt ev lb ve", _TIMES | {
    "cx": "SELECT region_id, node, unnest(vec)::DOUBLE AS x, unnest(range(1, len(vec) + 1)) AS d FROM cur JOIN ve USING (node)", "cc": "SELECT region_id, d, avg(x) AS c FROM cx GROUP BY ALL",
    "ox": "SELECT parent_id, node, unnest(vec)::DOUBLE AS x, unnest(range(1, len(vec) + 1)) AS d FROM old JOIN ve USING (node)", "oc": "SELECT parent_id, d, avg(x) AS c FROM ox GROUP BY ALL"}))
def _(b: Baskets) -> DataFrame:
    now, before = _at(b, 2000, 1, "region_id"), _at(b, 1999, 0, "region_id")
    spread = lambda t: t.select("region_id", F.explode("members").alias("node"))
    out = features.embedding_influx(spread(now), spread(before), graph.lineage(now, before, 0.02), b.vectors)
    return out.select("region_id", *[F.round(c, 5).alias(c) for c in ("embedding_spread", "embedding_influx")], "embedding_missing")


_PROF = {
    "ls": CTE["ls"],
    "bi": "SELECT concept FROM (SELECT a.concept, min(a.year) AS t FROM ls a JOIN ls b ON a.concept = b.concept AND b.year = a.year + 1, ky WHERE a.n >= k AND b.n >= k AND a.year <= 1999 GROUP BY 1) WHERE t BETWEEN 1998 AND 1999",
    "own": "SELECT DISTINCT concept, paper_id, v1_date FROM lb",
    "fi": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY v1_date, paper_id) AS rn FROM own WHERE concept IN (SELECT concept FROM bi)) WHERE rn <= 20",
    "fn": "SELECT concept, count(*) AS nf FROM fi GROUP BY 1",
    "od": "SELECT concept AS member, count(*) AS df FROM own GROUP BY 1",
    "cm": "SELECT f.concept, o.concept AS member, count(*) AS n FROM fi f JOIN own o ON o.paper_id = f.paper_id AND o.concept <> f.concept GROUP BY ALL HAVING count(*) >= 2",
    "pf": """SELECT concept, member, n, lift, row_number() OVER (PARTITION BY concept ORDER BY round(lift, 9) DESC, member) AS rank FROM
        (SELECT concept, member, n, (n::DOUBLE / nf) / (df::DOUBLE / (SELECT count(DISTINCT paper_id) FROM own)) AS lift FROM cm JOIN fn USING (concept) JOIN od USING (member)) QUALIFY rank <= 10""",
}


@query("birth_profile", with_("SELECT concept, member, n, round(lift, 6) AS lift, rank::INT AS rank FROM pf", "pp lt ev ky lb", _PROF))
def _(b: Baskets) -> DataFrame:
    return b.profiles.select("concept", "member", "n", *r6("lift"), "rank")


_SUBSETS = """SELECT concat_ws(' + ', x.member, y.member) AS unit_id, [x.member, y.member] AS members, x.concept FROM {0} x JOIN {0} y ON x.concept = y.concept AND x.member < y.member
    UNION ALL SELECT concat_ws(' + ', x.member, y.member, z.member), [x.member, y.member, z.member], x.concept FROM {0} x JOIN {0} y ON x.concept = y.concept AND x.member < y.member JOIN {0} z ON z.concept = y.concept AND y.member < z.member"""
_SETS = _PROF | {
    "pd": "SELECT concept, max(v1_date) AS max_date FROM fi GROUP BY 1",
    "pa": "SELECT pf.* FROM pf JOIN pd USING (concept) JOIN lw USING (concept) WHERE lw.t <= 1999 AND year(max_date) <= 2000",
    "ss": "SELECT unit_id, any_value(members) AS members, count(*) AS support FROM (" + _SUBSETS.format("pa") + ") GROUP BY 1",
}


def _admitted(b: Baskets) -> DataFrame:
    return features.admissible(b.profiles, b.label_births.filter("crystallization_year is not null"), ORIGIN, b.cfg.m)


@query("parent_subprofiles", with_("SELECT replace(unit_id, ' + ', '|') AS members, support FROM ss WHERE support >= 2", "pp lt ev ky lb ls lw", _SETS))
def _(b: Baskets) -> DataFrame:
    return features.subprofiles(_admitted(b), 2).select(F.array_join("members", "|").alias("members"), "support")


@query("triangles_pace", with_("""SELECT a.u, a.v, c.v AS w, round(least(a.p, c.p, d.p), 6) AS score FROM jo a JOIN jo c ON a.v = c.u JOIN jo d ON d.u = a.u AND d.v = c.v ORDER BY least(a.p, c.p, d.p) DESC, 1, 2, 3 LIMIT 500""", "pp lt ev lb",
    window_ctes(ORIGIN) | {"jo": "SELECT u, v, count(*) / 3.0 AS p FROM bn JOIN wp a ON a.concept = u JOIN wp b ON b.concept = v AND a.paper_id = b.paper_id GROUP BY ALL"}))
def _(b: Baskets) -> DataFrame:
    return features.triangle_pace(b.strong(ORIGIN), b.labels, ORIGIN).select("u", "v", "w", *r6("score"))


_TRIANGLES = {"jo": "SELECT u, v, count(*) / 3.0 AS p FROM bn JOIN wp a ON a.concept = u JOIN wp b ON b.concept = v AND a.paper_id = b.paper_id GROUP BY ALL",
    "tp5": "SELECT a.u, a.v, c.v AS w FROM jo a JOIN jo c ON a.v = c.u JOIN jo d ON d.u = a.u AND d.v = c.v ORDER BY least(a.p, c.p, d.p) DESC, 1, 2, 3 LIMIT 500"}
_UNITS = _SETS | window_ctes(ORIGIN) | _TRIANGLES | {
    "su": "SELECT unit_id, members FROM ss WHERE support >= 1 ORDER BY support DESC, replace(unit_id, ' + ', chr(1)) LIMIT 750",
    "gu": "SELECT unit_id, any_value(members) AS members, CASE WHEN max(b) = 0 THEN 'sub_profile' WHEN max(a) = 0 THEN 'triangle' ELSE 'both' END AS generator FROM (SELECT unit_id, members, 1 AS a, 0 AS b FROM su UNION ALL SELECT concat_ws(' + ', u, v, w), [u, v, w], 0, 1 FROM tp5) GROUP BY 1",
    "us": "SELECT gu.*, coalesce(support, 0) AS support FROM gu LEFT JOIN (SELECT unit_id, support FROM ss) USING (unit_id)",
}


def _parent_sets(b: Baskets) -> DataFrame:
    every = checkpoint(features.subprofiles(_admitted(b), 1))
    return checkpoint(features.parent_sets(every, features.triangle_pace(checkpoint(b.strong(ORIGIN)), b.labels, ORIGIN), every))


@query("parent_sets", with_("SELECT unit_id, generator, support FROM us", "pp lt ev ky lb ls lw", _UNITS))
def _(b: Baskets) -> DataFrame:
    return _parent_sets(b).select("unit_id", "generator", "support")


_SET_FEATURES = _UNITS | {
    "um": "SELECT unit_id, unnest(members) AS node, len(members) AS size FROM us",
    "uh": "SELECT unit_id, paper_id, any_value(year) AS year, any_value(quarter) AS quarter, count(DISTINCT node) AS hits, any_value(size) AS size FROM um JOIN lb ON concept = node WHERE year BETWEEN 1996 AND 2000 GROUP BY unit_id, paper_id",
    "un": "SELECT unit_id, count(*) FILTER (year = 2000) AS n_t, count(*) FILTER (year = 1999) AS n_t1, count(*) FILTER (year = 1998) AS n_t2, count(*) / 3.0 AS pace, count(*) FILTER (hits >= least(2, size) AND year = 2000) AS joint_papers_t, count(*) FILTER (hits >= least(2, size)) AS joint_papers_window FROM uh GROUP BY 1",
    "uq": "SELECT unit_id, avg(a / greatest(1.0, p) - p / greatest(1.0, pp)) AS acc FROM (SELECT unit_id, q, count(*) FILTER (year = 2000 AND quarter = q)::DOUBLE AS a, count(*) FILTER (year = 1999 AND quarter = q)::DOUBLE AS p, count(*) FILTER (year = 1998 AND quarter = q)::DOUBLE AS pp FROM uh, range(1, 5) t(q) GROUP BY ALL) GROUP BY 1",
    "ui": "SELECT unit_id, sum(now * (1 - past))::DOUBLE / sum(now) AS influx FROM (SELECT unit_id, author, max((year = 2000)::INT) AS now, max((year < 2000)::INT) AS past FROM uh JOIN au USING (paper_id) WHERE year BETWEEN 1998 AND 2000 GROUP BY ALL) GROUP BY 1 HAVING sum(now) > 0",
    "ux": "SELECT unit_id, node, unnest(vec)::DOUBLE AS x, unnest(range(1, len(vec) + 1)) AS d FROM um JOIN ve USING (node)",
    "uc": "SELECT unit_id, d, avg(x) AS c FROM ux GROUP BY ALL",
    "ue": "SELECT unit_id, avg(1 - cosine) AS spread FROM (SELECT unit_id, node, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM ux JOIN uc USING (unit_id, d) GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 2",
}


@query("parent_set_features", with_("""SELECT unit_id, n_t, n_t1, n_t2, round(n_t / greatest(1.0, n_t1), 6) AS paper_velocity_1y, round(n_t / greatest(1.0, (n_t1 + n_t2) / 2), 6) AS paper_velocity_2y, joint_papers_t, joint_papers_window, round(pace, 6) AS pace, round(influx, 6) AS author_influx,
    round(CASE WHEN n_t1 + n_t2 > 0 THEN acc END, 6) AS yoy_quarter_accel, round(spread, 5) AS embedding_spread, spread IS NULL AS embedding_missing, round(joint_papers_t::DOUBLE / n_t, 6) AS joint_share, joint_papers_window > 0 AS members_have_met
    FROM un LEFT JOIN uq USING (unit_id) LEFT JOIN ui USING (unit_id) LEFT JOIN ue USING (unit_id) WHERE n_t > 0""", "pp lt ev au ky lb ls lw ve", _SET_FEATURES))
def _(b: Baskets) -> DataFrame:
    out = features.unit_features(_parent_sets(b), b.labels, b.authors, ORIGIN, b.vectors)
    return out.select("unit_id", "n_t", "n_t1", "n_t2", *r6("paper_velocity_1y", "paper_velocity_2y"), "joint_papers_t", "joint_papers_window", *r6("pace", "author_influx", "yoy_quarter_accel"), F.round("embedding_spread", 5).alias("embedding_spread"), "embedding_missing", *r6("joint_share"), "members_have_met")


# --- attachment and evaluation ----------------------------------------------------------------------------------------

_ATT = _PROF | {
    "rs": "SELECT region_id, count(*) AS r FROM bk GROUP BY 1",
    "pn": "SELECT concept, count(*) AS p FROM pf GROUP BY 1",
    "vv": "SELECT count(DISTINCT concept) AS v FROM lb WHERE year BETWEEN 1995 AND 1997",
    "ho": "SELECT pf.concept, bk.region_id, count(*) AS o, any_value(r) AS r, any_value(p) AS p, any_value(v) AS v FROM pf JOIN bk ON node = member JOIN rs USING (region_id) JOIN pn USING (concept), vv GROUP BY ALL",
    "hy": """SELECT concept, region_id, o, (SELECT sum(CASE WHEN i > r OR p - i > v - r THEN 0 ELSE exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(v - r + 1) - lgamma(p - i + 1) - lgamma(v - r - p + i + 1)
        - lgamma(v + 1) + lgamma(p + 1) + lgamma(v - p + 1)) END) FROM range(o, least(p, r) + 1) t(i)) AS s FROM ho""",
    "att": "SELECT concept, region_id AS unit_id, o AS overlap, 1.0 / count(*) OVER (PARTITION BY concept) AS mass FROM hy WHERE o >= 3 OR s <= 1e-3",
}


@query("attach_hypergeom", with_("SELECT concept, region_id, o AS overlap, round(s, 6) AS surprise FROM hy", "pp lt ev ky lb bk", _ATT))
def _(b: Baskets) -> DataFrame:
    return attach.overlaps(b.profiles, b.blocks(), b.population(BEFORE)).select("concept", "region_id", "overlap", *r6("surprise"))


@query("attach_births", with_("""SELECT concept, unit_id, coalesce(overlap, 0) AS overlap, round(coalesce(mass, 0), 6) AS mass, unit_id IS NULL AS orphan FROM (SELECT DISTINCT concept FROM pf) LEFT JOIN att USING (concept)""", "pp lt ev ky lb bk", _ATT))
def _(b: Baskets) -> DataFrame:
    return b.attached.select("concept", "unit_id", "overlap", *r6("mass"), "orphan")


@query("target_mass", with_("SELECT unit_id, round(sum(mass), 6) AS births_mass FROM att GROUP BY 1", "pp lt ev ky lb bk", _ATT))
def _(b: Baskets) -> DataFrame:
    return attach.targets(b.attached).select("unit_id", *r6("births_mass"))


@query("target_mass_invariant", with_("SELECT round(sum(mass), 6) AS total_mass, count(DISTINCT concept) AS n_attached FROM att", "pp lt ev ky lb bk", _ATT))
def _(b: Baskets) -> DataFrame:
    return attach.target_mass(b.attached)


@query("birth_history", with_("SELECT region_id AS unit_id, round(coalesce(sum(mass), 0), 6) AS confirmed_births_mass, count(att.concept) AS confirmed_births_count FROM rs LEFT JOIN att ON unit_id = region_id GROUP BY 1", "pp lt ev ky lb bk", _ATT))
def _(b: Baskets) -> DataFrame:
    return attach.history(b.blocks(), b.attached).select("unit_id", *r6("confirmed_births_mass"), "confirmed_births_count")


def _attached_ctes(origin: int) -> dict[str, str]:
    """Births of the two years after an origin, attached to overlapping regions; names end with the origin."""
    made = {
        "bi": f"SELECT concept FROM lw WHERE t BETWEEN {origin + 1} AND {origin + 2}", "own": _PROF["own"], "fi": _PROF["fi"], "fn": _PROF["fn"], "od": _PROF["od"], "cm": _PROF["cm"], "pf": _PROF["pf"],
        "rs": "SELECT region_id, count(*) AS r FROM two GROUP BY 1", "pn": _ATT["pn"], "vv": f"SELECT count(DISTINCT concept) AS v FROM lb WHERE year BETWEEN {origin - 2} AND {origin}",
        "ho": _ATT["ho"].replace("JOIN bk", "JOIN two").replace("bk.region_id", "two.region_id"), "hy": _ATT["hy"], "att": _ATT["att"],
    }
    return {f"{n}_{origin}": re.sub(r"\b(" + "|".join(made) + r")\b(?=[\s.,)]|$)", rf"\1_{origin}", q) for n, q in made.items()}


_ORIGINS = (1996, 1997, 1998)


@query("dual_gate", with_("SELECT avg(n) AS mean_dual, string_agg(n::VARCHAR, ',' ORDER BY o) AS per_origin, CASE WHEN avg(n) >= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (" + " UNION ALL ".join(
    f"SELECT {o} AS o, (SELECT count(*) FROM (SELECT concept FROM att_{o} GROUP BY 1 HAVING count(*) >= 2)) AS n" for o in _ORIGINS) + ")", "pp lt ev ky lb bk two ls lw", {n: q for o in _ORIGINS for n, q in _attached_ctes(o).items()}))
def _(b: Baskets) -> DataFrame:
    every = None
    for o in _ORIGINS:
        one = b.attached_at(o).select("origin", "concept", "n_attachments")
        every = one if every is None else every.union(one)
    return attach.dual_gate(every, list(_ORIGINS), 1)


@query("attach_two", with_("SELECT concept, unit_id, coalesce(overlap, 0) AS overlap, round(coalesce(mass, 0), 6) AS mass, unit_id IS NULL AS orphan FROM (SELECT DISTINCT concept FROM pf_1997) LEFT JOIN att_1997 USING (concept)", "pp lt ev ky lb bk two ls lw", _attached_ctes(1997)))
def _(b: Baskets) -> DataFrame:
    return b.attached_at(BEFORE).select("concept", "unit_id", "overlap", *r6("mass"), "orphan")


def _truth(b: Baskets) -> DataFrame:
    return checkpoint(evaluate.truths(b.attached, b.profiles, b.blocks()))


def _degree_ranks(b: Baskets) -> DataFrame:
    scored = evaluate.node_features(b.blocks(), b.labels, b.strong(BEFORE), BEFORE).select("region_id", "node", F.col("n_t").cast("double").alias("score"))
    return checkpoint(evaluate.ranked(scored))


_EVAL = _ATT | {
    "tr": "SELECT att.unit_id AS region_id, att.concept, pf.member AS node FROM att JOIN pf USING (concept) JOIN bk ON bk.region_id = att.unit_id AND bk.node = pf.member",
    "nt": "SELECT bk.region_id, bk.node, count(DISTINCT CASE WHEN year = 1997 THEN paper_id END) AS n_t FROM bk LEFT JOIN lb ON concept = bk.node GROUP BY ALL",
    "rk": "SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n_t DESC, node) AS rank, count(*) OVER (PARTITION BY region_id) AS size FROM nt",
    "hh": "SELECT region_id, concept, rank, size, row_number() OVER (PARTITION BY region_id, concept ORDER BY rank) AS hits, count(*) OVER (PARTITION BY region_id, concept) AS n_true FROM tr JOIN rk USING (region_id, node)",
}


def _score_sql(k: int) -> str:
    return f"""SELECT region_id, count(*) AS n_births, avg(recall) AS recall_at_k, avg(hit) AS hit_rate, avg(mr) AS mean_true_rank, avg(nr) AS norm_rank, avg(ap) AS avg_precision FROM (SELECT region_id, concept, sum((rank <= {k})::INT)::DOUBLE / max(n_true) AS recall,
        max((rank <= {k})::INT)::DOUBLE AS hit, avg(rank) AS mr, avg(rank::DOUBLE / size) AS nr, sum(hits::DOUBLE / rank) / max(n_true) AS ap FROM hh WHERE size > {k} GROUP BY ALL) GROUP BY 1"""


_ROUNDED = "round(recall_at_k, 6) AS recall_at_k, round(hit_rate, 6) AS hit_rate, round(mean_true_rank, 6) AS mean_true_rank"


@query("recall_at_k", with_(f"SELECT region_id, n_births, {_ROUNDED}, round(norm_rank, 6) AS norm_rank, round(avg_precision, 6) AS avg_precision FROM ({_score_sql(10)})", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    return evaluate.scores(_degree_ranks(b), _truth(b), 10).select("region_id", "n_births", *r6("recall_at_k", "hit_rate", "mean_true_rank", "norm_rank", "avg_precision"))


@query("k_sweep", with_(" UNION ALL ".join(f"SELECT {k} AS k, sum(n_births)::BIGINT AS n_births, round(sum(n_births * recall_at_k) / sum(n_births), 6) AS recall_at_k, round(sum(n_births * avg_precision) / sum(n_births), 6) AS avg_precision FROM ({_score_sql(k)})" for k in (1, 5, 10, 20)), "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    ranks, truth, out = _degree_ranks(b), _truth(b), None
    for k in (1, 5, 10, 20):
        one = evaluate.weighted(evaluate.scores(ranks, truth, k)).select(F.lit(k).alias("k"), "n_births", *r6("recall_at_k", "avg_precision"))
        out = one if out is None else out.union(one)
    return out


@query("truth_sets", with_("SELECT * FROM tr", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    return _truth(b)


@query("hub_cut", with_("SELECT region_id, node, n_t FROM nt WHERE n_t <= (SELECT quantile_cont(n_t, 0.95) FROM nt)", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    n = evaluate.node_features(b.blocks(), b.labels, b.strong(BEFORE), BEFORE).select("region_id", "node", "n_t")
    cut = n.agg(F.percentile("n_t", F.lit(0.95)).alias("cut"))
    return n.filter(F.col("n_t") <= cut.scalar())


@query("node_z_scores", with_("SELECT region_id, node, round(coalesce((n_t - avg(n_t) OVER w) / nullif(stddev_samp(n_t) OVER w, 0), 0), 6) AS z_n_t FROM nt WINDOW w AS (PARTITION BY region_id)", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    return evaluate.node_features(b.blocks(), b.labels, b.strong(BEFORE), BEFORE).select("region_id", "node", *r6("z_n_t"))


_SCORED = {
    "s20": _score_sql(20),
    "rr": "SELECT region_id, node, row_number() OVER (PARTITION BY region_id ORDER BY substr(md5('7|' || region_id || '|' || node), 1, 13) DESC, node)::INT AS rank, count(*) OVER (PARTITION BY region_id) AS size FROM bk",
    "hr": "SELECT region_id, concept, rank, size, row_number() OVER (PARTITION BY region_id, concept ORDER BY rank) AS hits, count(*) OVER (PARTITION BY region_id, concept) AS n_true FROM tr JOIN rr USING (region_id, node)",
    "r20": _score_sql(20).replace("FROM hh", "FROM hr"),
    "pr2": "SELECT row_number() OVER (ORDER BY s20.region_id) - 1 AS i, count(*) OVER () AS size, s20.n_births AS w, s20.recall_at_k AS x, r20.recall_at_k AS y FROM s20 JOIN r20 USING (region_id)",
    "dr": "SELECT rep, floor(('0x' || substr(md5('7|' || rep || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 * size)::INT AS i FROM pr2, range(0, 2000) t(rep)",
    "lf": "SELECT lift, row_number() OVER (ORDER BY lift, rep) - 1 AS r FROM (SELECT rep, sum(w * x) / nullif(sum(w * y), 0) AS lift FROM dr JOIN pr2 USING (i) GROUP BY 1)",
}


@query("bootstrap_ci", with_("SELECT round((SELECT sum(w * x) / nullif(sum(w * y), 0) FROM pr2), 6) AS lift, round(max(lift) FILTER (r = 50), 6) AS low, round(max(lift) FILTER (r = 1950), 6) AS high FROM lf", "pp lt ev ky lb bk", _EVAL | _SCORED))
def _(b: Baskets) -> DataFrame:
    truth = _truth(b)
    chance = evaluate.ranked(b.blocks().withColumn("score", evaluate.random_score(7, "region_id", "node")))
    return evaluate.bootstrap(checkpoint(evaluate.scores(_degree_ranks(b), truth, 20)), checkpoint(evaluate.scores(chance, truth, 20)), b.cfg.bootstrap).select(*r6("lift", "low", "high"))


@query("year_bootstrap", """WITH a AS (SELECT year(o_orderdate)::INT AS origin, o_custkey % 25 AS region_id, count(*) AS n, avg((o_totalprice > 100000)::INT) AS x, avg((o_totalprice > 150000)::INT) AS y FROM orders GROUP BY ALL),
    s AS (SELECT origin, sum(n * x) AS x, sum(n * y) AS y, row_number() OVER (ORDER BY origin) - 1 AS i, count(*) OVER () AS size FROM a GROUP BY origin),
    d AS (SELECT rep, floor(('0x' || substr(md5('7|' || rep || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 * size)::INT AS i FROM s, range(0, 2000) t(rep)),
    l AS (SELECT lift, row_number() OVER (ORDER BY lift, rep) - 1 AS r FROM (SELECT rep, sum(x) / greatest(1e-9, sum(y)) AS lift FROM d JOIN s USING (i) GROUP BY rep))
    SELECT round(avg(lift), 6) AS lift, round(max(lift) FILTER (r = 50), 6) AS low, round(max(lift) FILTER (r = 1950), 6) AS high FROM l""")
def _(b: Baskets) -> DataFrame:
    keys = [F.year("o_orderdate").alias("origin"), (F.col("o_custkey") % 25).alias("region_id")]
    of = lambda least: b.read("orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_births"), F.avg((F.col("o_totalprice") > least).cast("int")).alias("recall_at_k"))
    return evaluate.year_bootstrap(of(100000), of(150000), b.cfg.bootstrap).select(*r6("lift", "low", "high"))


@query("select_best", with_("SELECT k AS setting, round(val_recall, 6) AS val_recall FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(n_births * recall_at_k) / sum(n_births) AS val_recall FROM ({_score_sql(k)})" for k in (1, 5, 10, 20)) + ") WHERE val_recall IS NOT NULL ORDER BY round(val_recall, 12) DESC, k LIMIT 1", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    ranks, truth, out = _degree_ranks(b), _truth(b), None
    for k in (1, 5, 10, 20):
        one = evaluate.scores(ranks, truth, k).select(F.lit(k).alias("setting"), F.lit(0).alias("k"), "region_id", "n_births", "recall_at_k")
        out = one if out is None else out.union(one)
    return evaluate.select_best(out, ["setting"], 0).select("setting", *r6("val_recall"))


@query("oracle_greedy", with_("""SELECT region_id, string_agg(node, '|' ORDER BY r) AS picks, round(sum(gain) / any_value(b), 6) AS oracle_recall FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(gain, 9) DESC, node) AS r FROM
    (SELECT region_id, node, sum(w) AS gain FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY region_id, concept) AS w FROM tr) GROUP BY ALL)) JOIN (SELECT region_id, count(DISTINCT concept) AS b FROM tr GROUP BY 1) USING (region_id) WHERE r <= 10 GROUP BY 1""", "pp lt ev ky lb bk", _EVAL))
def _(b: Baskets) -> DataFrame:
    return evaluate.greedy_oracle(_truth(b), 10).select("region_id", F.array_join("picks", "|").alias("picks"), *r6("oracle_recall"))


_NODE = window_ctes(ORIGIN) | _NODE_VECTORS | {
    "bw": "SELECT u AS node, v AS other FROM bn UNION ALL SELECT v, u FROM bn",
    "pn": "SELECT concept AS node, count(DISTINCT paper_id) FILTER (year = 2000) AS n_t, count(DISTINCT paper_id) FILTER (year = 1999) AS n_t1, count(DISTINCT paper_id) FILTER (year = 1998) AS n_t2 FROM lb WHERE year BETWEEN 1998 AND 2000 GROUP BY 1",
    "co": "SELECT bw.node, bw.other, count(*) AS co FROM bw JOIN wp a ON a.concept = bw.node JOIN wp b ON b.concept = bw.other AND b.paper_id = a.paper_id GROUP BY ALL",
    "ne": "SELECT two.region_id, two.node, count(m.node) AS degree_in, coalesce(sum(co) FILTER (m.node IS NOT NULL), 0) AS co, count(bw.other) AS degree FROM two LEFT JOIN bw ON bw.node = two.node LEFT JOIN two m ON m.region_id = two.region_id AND m.node = bw.other LEFT JOIN co ON co.node = bw.node AND co.other = bw.other GROUP BY ALL",
}


@query("node_features", with_("""SELECT region_id, node, coalesce(n_t, 0) AS n_t, round(coalesce(n_t, 0) / greatest(1.0, n_t1), 6) AS velocity, round(coalesce(n_t, 0) / greatest(1.0, (n_t1 + n_t2) / 2), 6) AS velocity_2y, degree, degree_in, round(degree_in / greatest(1.0, size - 1), 6) AS rel_size,
    round(co / greatest(1.0, degree_in) / 3.0, 6) AS pace_in_region, (2000 - coalesce(coinage_year, 2000))::INT AS coinage_age, coalesce(cry IN (1998, 1999) AND cry <= 1999, false)::INT AS recent_birth, round(CASE WHEN nd.n >= 3 THEN dist END, 5) AS emb_dist_to_centroid
    FROM ne JOIN (SELECT region_id, count(*) AS size FROM two GROUP BY 1) USING (region_id) LEFT JOIN pn USING (node) LEFT JOIN bt ON concept = node LEFT JOIN nd USING (region_id, node)""", "pp lt ev ky lb bk two ve ls lw bt", _NODE))
def _(b: Baskets) -> DataFrame:
    out = evaluate.node_features(b.two(), b.labels, b.strong(ORIGIN), ORIGIN, b.label_births, b.vectors)
    return out.select("region_id", "node", "n_t", *r6("velocity", "velocity_2y"), "degree", "degree_in", *r6("rel_size", "pace_in_region"), "coinage_age", "recent_birth", F.round("emb_dist_to_centroid", 5).alias("emb_dist_to_centroid"))


@query("node_author_influx", with_("""SELECT region_id, node, round(coalesce(sum(now * (1 - past))::DOUBLE / nullif(sum(now), 0), 0), 6) AS author_influx_node FROM bk LEFT JOIN (SELECT concept, author, max((year = 2000)::INT) AS now, max((year < 2000)::INT) AS past FROM lb JOIN au USING (paper_id) WHERE year BETWEEN 1998 AND 2000 GROUP BY ALL) ON concept = node GROUP BY ALL""", "pp lt ev au lb bk"))
def _(b: Baskets) -> DataFrame:
    return evaluate.node_author_influx(b.blocks(), b.labels, b.authors, ORIGIN, b.tasks).select("region_id", "node", *r6("author_influx_node"))


@query("random_baseline", with_("SELECT region_id, node, row_number() OVER (PARTITION BY region_id ORDER BY substr(md5('7|' || region_id || '|' || node), 1, 13) DESC, node)::INT AS rank FROM bk", "pp lt ev lb bk"))
def _(b: Baskets) -> DataFrame:
    return evaluate.ranked(b.blocks().withColumn("score", evaluate.random_score(7, "region_id", "node"))).select("region_id", "node", "rank")


# --- structure --------------------------------------------------------------------------------------------------------


@query("local_structure", with_("""SELECT region_id, node, deg_in, triangles, round(CASE WHEN deg_in > 1 THEN 2.0 * triangles / (deg_in * (deg_in - 1)) ELSE 0 END, 6) AS clustering FROM (SELECT region_id, node,
    (SELECT count(*) FROM inn WHERE inn.region_id = bk.region_id AND bk.node IN (u, v)) AS deg_in,
    (SELECT count(*) FROM inn a JOIN inn c ON a.v = c.u AND a.region_id = c.region_id JOIN inn d ON d.u = a.u AND d.v = c.v AND d.region_id = a.region_id WHERE a.region_id = bk.region_id AND bk.node IN (a.u, a.v, c.v)) AS triangles FROM bk)""", "pp lt ev lb bk", window_ctes(ORIGIN) | _INNER))
def _(b: Baskets) -> DataFrame:
    edges = b.edges(ORIGIN).filter((F.col("n_papers") >= b.cfg.binarize_papers) & (F.col("lift") >= b.cfg.binarize_lift)).select("u", "v", "weight")
    return structure.local(b.blocks(), edges).select("region_id", "node", "deg_in", "triangles", *r6("clustering"))


_BOTH = {"bw": "SELECT u AS node, v AS other FROM bn UNION ALL SELECT v, u FROM bn"}


_WEIGHTED = {"be": "SELECT u, v, weight FROM eg WHERE n_papers >= 4 AND lift >= 2.0", "bx": "SELECT u AS node, v AS other, weight FROM be UNION ALL SELECT v, u, weight FROM be"}


@query("boundary_structure", with_("""SELECT region_id, node, degree, ext_degree, round(ext_degree / greatest(1.0, degree), 6) AS ext_ratio, round(ext_degree::DOUBLE / size, 6) AS ext_deg_norm, round(bridge_mass, 6) AS bridge_mass, n_other_regions, homes > 1 AS is_dual_citizen FROM
    (SELECT two.region_id, two.node, count(other) AS degree, count(other) FILTER (m.node IS NULL) AS ext_degree, coalesce(sum(weight) FILTER (m.node IS NULL AND other IS NOT NULL), 0) AS bridge_mass FROM two LEFT JOIN bx ON bx.node = two.node LEFT JOIN two m ON m.region_id = two.region_id AND m.node = other GROUP BY ALL)
    LEFT JOIN (SELECT two.region_id, two.node, count(DISTINCT r.region_id) AS n_other_regions FROM two LEFT JOIN bx ON bx.node = two.node LEFT JOIN two m ON m.region_id = two.region_id AND m.node = other LEFT JOIN two r ON r.node = other AND r.region_id <> two.region_id AND m.node IS NULL GROUP BY ALL) USING (region_id, node)
    JOIN (SELECT region_id, count(*) AS size FROM two GROUP BY 1) USING (region_id) JOIN (SELECT node, count(*) AS homes FROM two GROUP BY 1) USING (node)""", "pp lt ev lb bk two", window_ctes(ORIGIN) | _WEIGHTED))
def _(b: Baskets) -> DataFrame:
    out = structure.boundary(b.two(), b.weighted(ORIGIN))
    return out.select("region_id", "node", "degree", "ext_degree", *r6("ext_ratio", "ext_deg_norm", "bridge_mass"), "n_other_regions", "is_dual_citizen")


@query("neighbour_structure", with_("""SELECT two.region_id, two.node, round(coalesce(avg(coalesce(n_t, 0) / greatest(1.0, n_t1)) FILTER (m.node IS NOT NULL), 0), 6) AS nb_mean_velocity, round(coalesce(max(coalesce(n_t, 0) / greatest(1.0, n_t1)) FILTER (m.node IS NOT NULL), 0), 6) AS nb_max_velocity, round(coalesce(avg(coalesce(n_t, 0)) FILTER (m.node IS NOT NULL), 0), 6) AS nb_mean_n_t,
    round(coalesce(avg(coalesce(cry BETWEEN 1998 AND 1999, false)::INT) FILTER (m.node IS NOT NULL), 0), 6) AS nb_recent_share, round(coalesce(avg(2000 - coalesce(coinage_year, 2000)) FILTER (m.node IS NOT NULL), 0), 6) AS nb_mean_coinage_age
    FROM two LEFT JOIN bw ON bw.node = two.node LEFT JOIN two m ON m.region_id = two.region_id AND m.node = other LEFT JOIN pn ON pn.node = m.node LEFT JOIN bt ON concept = m.node GROUP BY ALL""", "pp lt ev ky lb bk two ls lw bt", window_ctes(ORIGIN) | {n: _NODE[n] for n in ("bw", "pn")}))
def _(b: Baskets) -> DataFrame:
    values = evaluate.node_features(b.two(), b.labels, b.strong(ORIGIN), ORIGIN).select("node", "n_t", "velocity").distinct()
    out = structure.neighbour(b.two(), b.strong(ORIGIN), values, b.label_births, ORIGIN, b.cfg.m)
    return out.select("region_id", "node", *r6("nb_mean_velocity", "nb_max_velocity", "nb_mean_n_t", "nb_recent_share", "nb_mean_coinage_age"))


_GRAPHS = window_ctes(ORIGIN) | _WEIGHTED | {n: q for n, q in _INNER_PAST.items() if n != "inn1"} | {
    n.replace("1", "2"): q.replace("1998", "~").replace("1999", "1998").replace("~", "1997").replace("1997 AND 1999", "1996 AND 1998").replace("wp1", "wp2").replace("wd1", "wd2").replace("cp1", "cp2").replace("pr1", "pr2").replace("eg1", "eg2") for n, q in _INNER_PAST.items() if n != "inn1"}
_GRAPHS |= {"wp2": _INNER_PAST["wp1"].replace(f"BETWEEN {ORIGIN - 3} AND {ORIGIN - 1}", f"BETWEEN {ORIGIN - 4} AND {ORIGIN - 2}")}
_GRAPHS |= {
    "fl": "SELECT node, other, max(g0) AS g0, max(g1) AS g1, max(g2) AS g2 FROM (" + " UNION ALL ".join(f"SELECT {a} AS node, {b} AS other, {g} FROM {t}" for t, g in (("bn", "1 AS g0, 0 AS g1, 0 AS g2"), ("bn1", "0, 1, 0"), ("bn2", "0, 0, 1")) for a, b in (("u", "v"), ("v", "u"))) + ") GROUP BY ALL",
    "fp": """SELECT node, sum(g0) AS d0, sum(g1) AS d1, sum(g2) AS d2, count(*) FILTER (g0 = 1 AND g1 = 0) AS fresh, count(*) FILTER (g0 = 0 AND g1 = 1) AS lost, count(*) FILTER (g0 = 1 OR g1 = 1) AS either,
        avg(CASE WHEN g1 = 0 THEN 0 WHEN g2 = 0 THEN 1 ELSE 2 END) FILTER (g0 = 1) AS age, min(CASE WHEN g1 = 0 THEN 0 WHEN g2 = 0 THEN 1 ELSE 2 END) FILTER (g0 = 1) AS newest FROM fl GROUP BY 1""",
    "wi": "SELECT bk.region_id, bk.node, sum(weight) AS w FROM bk JOIN bx ON bx.node = bk.node JOIN bk m ON m.region_id = bk.region_id AND m.node = other GROUP BY ALL",
}


@query("dynamic_structure", with_("""SELECT region_id, node, round(coalesce(d0, 0) / greatest(1.0, d1), 6) AS deg_growth_1y, round(coalesce(d0, 0) / greatest(1.0, (d1 + d2) / 2), 6) AS deg_growth_2y, round(coalesce(fresh, 0) / greatest(1.0, d0), 6) AS new_edge_share, round(coalesce(age, 0), 6) AS edge_mean_age,
    coalesce(newest, 2)::DOUBLE AS newest_edge_age, round(coalesce(fresh + lost, 0) / greatest(1.0, either), 6) AS edge_turnover, round(coalesce(w, 0) / greatest(1.0, d1), 6) AS wdeg_growth FROM bk LEFT JOIN fp USING (node) LEFT JOIN wi USING (region_id, node)""", "pp lt ev lb bk", _GRAPHS))
def _(b: Baskets) -> DataFrame:
    out = structure.dynamic(b.blocks(), [b.weighted(ORIGIN), b.strong(ORIGIN - 1), b.strong(ORIGIN - 2)])
    return out.select("region_id", "node", *r6("deg_growth_1y", "deg_growth_2y", "new_edge_share", "edge_mean_age", "newest_edge_age", "edge_turnover", "wdeg_growth"))


@query("burt_brokerage", with_("""SELECT node, degree, round(degree - 2.0 * t / degree, 6) AS effective_size, round(c, 6) AS burt_constraint FROM (SELECT node, count(*) AS degree FROM bw GROUP BY 1) JOIN
    (SELECT x.node, sum(power(1.0 / dx.d + coalesce((SELECT sum(1.0 / dx.d / dm.d) FROM bw y JOIN bw z ON z.node = y.other JOIN dg dm ON dm.node = y.other WHERE y.node = x.node AND z.other = x.other), 0), 2)) AS c,
    sum((SELECT count(*) FROM bw y JOIN bw z ON z.node = y.other WHERE y.node = x.node AND z.other = x.other)) / 2 AS t FROM bw x JOIN dg dx ON dx.node = x.node GROUP BY 1) USING (node)""", "pp lt ev lb", window_ctes(ORIGIN) | _BOTH | {"dg": "SELECT node, count(*) AS d FROM bw GROUP BY 1"}))
def _(b: Baskets) -> DataFrame:
    return structure.brokerage(b.strong(ORIGIN)).select("node", "degree", *r6("effective_size", "burt_constraint"))


@query("centralities")
def _(b: Baskets) -> DataFrame:
    return structure.centralities(b.blocks(), b.strong(ORIGIN))


# --- text -------------------------------------------------------------------------------------------------------------


def _postings(b: Baskets, sizes: tuple[int, ...]) -> DataFrame:
    return corpus.ngram_postings(b.documents, sizes)


def _terms(b: Baskets) -> DataFrame:
    return corpus.ngram_counts(b.documents, (1, 2, 3)).filter(F.col("df") >= b.cfg.min_total_freq)


def _extracted(b: Baskets) -> dict[int, DataFrame]:
    return {corpus.RAKE: corpus.rake_phrases(b.tagged), corpus.CHUNK: corpus.noun_chunks(b.tagged)}


_LEDGER = "cand, count(*) AS df, min(v1_date) AS first_date, arg_min(id, (v1_date, id)) AS first_paper_id, (length(any_value(cand)) - length(replace(any_value(cand), ' ', '')) + 1)::INT AS n_tokens"


@query("ngram_ledger", with_(f"SELECT {_LEDGER}, 4 AS src_mask FROM (SELECT * FROM g2 UNION ALL SELECT * FROM g3) GROUP BY 1", "dc nl g2 g3"))
def _(b: Baskets) -> DataFrame:
    return corpus.ledger(_postings(b, (2, 3)))


@query("ledger", with_(f"SELECT cand, df, first_date, first_paper_id, n_tokens, (own | coalesce(src_mask, 0))::INT AS src_mask FROM (SELECT {_LEDGER}, max(own) AS own FROM ab GROUP BY 1) LEFT JOIN mk USING (cand)", MASKS + " nl g1 g2 g3 g4 g5 no ab"))
def _(b: Baskets) -> DataFrame:
    masks = corpus.provenance(_extracted(b))
    return corpus.ledger(corpus.all_postings(b.documents, b.cfg.max_tokens), masks, b.cfg.ngrams)


@query("ledger_yearly", with_("SELECT cand, year(v1_date)::INT AS year, count(*)::INT AS n_papers FROM ab GROUP BY ALL", MASKS + " nl g1 g2 g3 g4 g5 no ab"))
def _(b: Baskets) -> DataFrame:
    return corpus.ledger_yearly(corpus.all_postings(b.documents, b.cfg.max_tokens), corpus.provenance(_extracted(b)), b.cfg.ngrams)


@query("ledger_by_size", with_("SELECT n_tokens, src_mask, count(*) AS n, sum(df)::BIGINT AS total_df FROM (SELECT cand, (length(cand) - length(replace(cand, ' ', '')) + 1)::INT AS n_tokens, (max(own) | coalesce(any_value(src_mask), 0))::INT AS src_mask, count(*) AS df FROM ab LEFT JOIN mk USING (cand) GROUP BY 1) GROUP BY ALL", MASKS + " nl g1 g2 g3 g4 g5 no ab"))
def _(b: Baskets) -> DataFrame:
    masks = corpus.provenance(_extracted(b))
    rows = corpus.ledger(corpus.all_postings(b.documents, b.cfg.max_tokens), masks, b.cfg.ngrams)
    return rows.groupBy("n_tokens", "src_mask").agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("total_df"))


@query("dominant_pos", with_("SELECT lemma, dominant_pos, n_tokens, round(dominance, 6) AS dominance FROM dp", DOCS + " tg dp"))
def _(b: Baskets) -> DataFrame:
    return termhood.dominant_pos(termhood.lemma_pos_counts(b.tagged)).select("lemma", "dominant_pos", "n_tokens", *r6("dominance"))


@query("dominant_pos_asof", with_("SELECT lemma, max_by(pos, (n, pos)) AS dominant_pos, sum(n)::BIGINT AS n_tokens FROM (SELECT lemma, pos, count(*) AS n FROM tg WHERE year(v1_date) <= 2018 GROUP BY ALL) GROUP BY 1", DOCS + " tg"))
def _(b: Baskets) -> DataFrame:
    return termhood.dominant_pos(termhood.lemma_pos_counts(b.tagged, ("year",)), 2018).select("lemma", "dominant_pos", "n_tokens")


_SUB = "sub AS (SELECT DISTINCT c.cand AS container, c.df AS of, unnest(list_concat(string_split(c.cand, ' '), CASE WHEN len(string_split(c.cand, ' ')) = 3 THEN [string_split(c.cand, ' ')[1] || ' ' || string_split(c.cand, ' ')[2], string_split(c.cand, ' ')[2] || ' ' || string_split(c.cand, ' ')[3]] ELSE [] END)) AS cand FROM tm c WHERE contains(c.cand, ' '))"


@query("c_value", with_("", TERMS).rstrip() + ", " + _SUB.replace("sub AS (", "sub AS MATERIALIZED (") + """ SELECT cand, df, round(log2(length(cand) - length(replace(cand, ' ', '')) + 2) * (df - coalesce(m, 0)), 6) AS c_value, coalesce(n, 0)::INT AS n_containers
    FROM tm LEFT JOIN (SELECT cand, avg(of) AS m, count(*) AS n FROM sub WHERE cand IN (SELECT cand FROM tm) GROUP BY 1) USING (cand)""")
def _(b: Baskets) -> DataFrame:
    return termhood.c_value(_terms(b)).select("cand", "df", *r6("c_value"), "n_containers")


_KILL = rf"""CASE WHEN f.dominant_pos IN ('VERB', 'AUX') THEN 'verb_led' WHEN regexp_matches(w[1], '{termhood.ORDINAL}') THEN 'ordinal'
    WHEN list_bool_or(list_transform(w, lambda x: x IN ({_STOP}))) THEN 'stopword_straddler' WHEN coalesce(l.dominant_pos, '') NOT IN ('NOUN', 'PROPN') THEN 'non_nominal_head'
    WHEN list_bool_and(list_transform(w, lambda x: x IN ({_GENERIC}, {_STOP}))) THEN 'generic_head' WHEN NOT regexp_matches(cand, '\p{{L}}') THEN 'no_alpha' ELSE 'keep' END"""
_TAGS = "dc tk tg nl g1 g2 g3 po tm dp"
_WITH_TAGS = "(SELECT *, string_split(cand, ' ') AS w FROM tm) LEFT JOIN dp f ON f.lemma = w[1] LEFT JOIN dp l ON l.lemma = w[-1]"
_LOOSE = _KILL.replace(f"list_bool_or(list_transform(w, lambda x: x IN ({_STOP})))", f"(w[1] IN ({_STOP}) OR w[-1] IN ({_STOP}))")


@query("pattern_kill_reason", with_(f"SELECT cand, df, {_KILL} AS kill_reason FROM {_WITH_TAGS}", _TAGS))
def _(b: Baskets) -> DataFrame:
    return termhood.kill_reasons(_terms(b), termhood.dominant_pos(termhood.lemma_pos_counts(b.tagged)))


@query("kill_counts", with_(f"SELECT kill_reason, count(*) AS n FROM (SELECT {_KILL} AS kill_reason FROM {_WITH_TAGS}) GROUP BY 1", _TAGS))
def _(b: Baskets) -> DataFrame:
    return termhood.kill_reasons(_terms(b), termhood.dominant_pos(termhood.lemma_pos_counts(b.tagged))).groupBy("kill_reason").agg(F.count(F.lit(1)).alias("n"))


@query("kill_counts_loose", with_(f"SELECT kill_reason, count(*) AS n FROM (SELECT {_LOOSE} AS kill_reason FROM {_WITH_TAGS}) GROUP BY 1", _TAGS))
def _(b: Baskets) -> DataFrame:
    return termhood.kill_reasons(_terms(b), termhood.dominant_pos(termhood.lemma_pos_counts(b.tagged)), strict=False).groupBy("kill_reason").agg(F.count(F.lit(1)).alias("n"))


_PLURAL = """SELECT a.cand AS member, b.cand AS canonical FROM tm a JOIN tm b ON b.cand = regexp_extract(a.cand, '^(.*?)[^ ]+$', 1) || (SELECT CASE WHEN length(l) < 4 THEN NULL WHEN l LIKE '%ies' THEN regexp_replace(l, 'ies$', 'y')
    WHEN regexp_matches(l, '(ses|xes|zes|ches|shes)$') THEN regexp_replace(l, 'es$', '') WHEN l LIKE '%s' AND NOT regexp_matches(l, '(ss|us|is)$') THEN regexp_replace(l, 's$', '') END FROM (SELECT string_split(a.cand, ' ')[-1] AS l))"""


def _spelled(column: str) -> str:
    out = f"replace(replace({column}, '-', ''), ' ', '')"
    for british, american in text.SPELLINGS:
        out = f"regexp_replace({out}, '{british}\\b', '{american}', 'g')"
    return out


_VARIANT = f"SELECT cand AS member, canonical FROM (SELECT cand, first_value(cand) OVER (PARTITION BY {_spelled('cand')} ORDER BY df DESC, cand) AS canonical FROM tm) WHERE cand <> canonical"
_VOCAB = {
    "fq": "SELECT cand, count(*) AS df FROM po WHERE year(v1_date) <= 2020 GROUP BY 1 HAVING count(*) >= 9",
    "dq": "SELECT lemma, max_by(pos, (n, pos)) AS dominant_pos FROM (SELECT lemma, pos, count(*) AS n FROM tg WHERE year(v1_date) <= 2020 GROUP BY ALL) GROUP BY 1",
    "al": f"SELECT cand, df FROM (SELECT cand, df, {_KILL} AS reason FROM (SELECT *, string_split(cand, ' ') AS w FROM fq) LEFT JOIN dq f ON f.lemma = w[1] LEFT JOIN dq l ON l.lemma = w[-1]) WHERE reason = 'keep'",
    "su": _SUB.removeprefix("sub AS (").removesuffix(")").replace("FROM tm c", "FROM al c"),
    "cv": """SELECT cand, log2(length(cand) - length(replace(cand, ' ', '')) + 2) * (df - coalesce(m, 0)) AS c_value FROM al LEFT JOIN (SELECT cand, avg(of) AS m FROM su WHERE cand IN (SELECT cand FROM al) GROUP BY 1) USING (cand)""",
    "pl": f"SELECT member AS cand, min(canonical) AS cluster FROM ({_PLURAL}) GROUP BY 1",
    "mp": "SELECT cv.cand, c_value, CASE WHEN cluster IN (SELECT cand FROM al) THEN cluster ELSE cv.cand END AS cluster FROM cv LEFT JOIN pl ON pl.cand = cv.cand",
}


@query("vocab_asof", with_("SELECT cluster, count(DISTINCT id) AS df_t, count(DISTINCT cand) AS n_members, round(max(c_value), 6) AS c_value, min(v1_date) AS first_date FROM po JOIN mp USING (cand) WHERE v1_date <= DATE '2020-12-31' GROUP BY 1 HAVING max(c_value) > 0", "dc tk tg nl g1 g2 g3 po tm", _VOCAB))
def _(b: Baskets) -> DataFrame:
    postings = _postings(b, (1, 2, 3))
    variants = merges.plural_edges(_terms(b)).select(F.col("member").alias("cand"), F.col("canonical").alias("cluster"), F.to_date(F.lit("2018-06-30")).alias("effective_date"))
    variants = variants.groupBy("cand").agg(F.min("cluster").alias("cluster"), F.min("effective_date").alias("effective_date"))
    counts = termhood.lemma_pos_counts(b.tagged, ("year",))
    return termhood.vocabulary(corpus.ledger_yearly(postings), counts, variants, postings, 2020, b.cfg.min_total_freq).select("cluster", "df_t", "n_members", *r6("c_value"), "first_date")


@query("term_postings", with_("SELECT id, cand FROM po WHERE cand IN (SELECT cand FROM tm)", TERMS))
def _(b: Baskets) -> DataFrame:
    return corpus.dictionary_postings(b.documents, _terms(b), (1, 2, 3)).select("id", "cand")


@query("missing_terms", with_("SELECT cand FROM (VALUES ('the'), ('no such term'), ('of the')) v(cand) WHERE cand NOT IN (SELECT cand FROM tm)", TERMS))
def _(b: Baskets) -> DataFrame:
    return corpus.missing_terms(_terms(b), ["the", "no such term", "of the"])


@query("quantile_grid", with_("", TERMS).rstrip() + """ SELECT f.floor::DOUBLE AS floor, count(CASE WHEN df > f.floor THEN 1 END) AS n_above FROM tm, (SELECT unnest([10, 20, 50, 100, 200]) AS floor) f GROUP BY 1""")
def _(b: Baskets) -> DataFrame:
    return termhood.floors(_terms(b), "df", [10, 20, 50, 100, 200])


@query("df_quantiles", with_("SELECT quantile_cont(df::DOUBLE, 0.25) AS q25, median(df::DOUBLE) AS q50, quantile_cont(df::DOUBLE, 0.75) AS q75 FROM tm", TERMS))
def _(b: Baskets) -> DataFrame:
    return _terms(b).agg(F.percentile("df", F.lit(0.25)).alias("q25"), F.median("df").alias("q50"), F.percentile("df", F.lit(0.75)).alias("q75"))


@query("rake_phrases", with_("SELECT * FROM rk", DOCS + " rk"))
def _(b: Baskets) -> DataFrame:
    return corpus.rake_phrases(b.tagged)


@query("noun_chunks", with_("SELECT * FROM ch", DOCS + " tg ch"))
def _(b: Baskets) -> DataFrame:
    return corpus.noun_chunks(b.tagged)


@query("provenance_mask", with_("SELECT * FROM mk", MASKS))
def _(b: Baskets) -> DataFrame:
    return corpus.provenance(_extracted(b))


@query("nominations", with_("SELECT * FROM no", MASKS + " no"))
def _(b: Baskets) -> DataFrame:
    return corpus.nominations(_extracted(b))


@query("string_variants", with_(_VARIANT, TERMS))
def _(b: Baskets) -> DataFrame:
    return merges.string_variants(_terms(b))


_SURFACE = r"""SELECT cand, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(translate(text, '‐‑‒–—−', '------')), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[-''’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*){0,30}'))) AS cand FROM documents)
    WHERE regexp_matches(cand, '\p{L}') GROUP BY 1 HAVING count(*) >= 9"""


def _surface_terms(b: Baskets) -> DataFrame:
    return corpus.ngram_postings(b.surface, (1,)).groupBy("cand").agg(F.count(F.lit(1)).alias("df"), F.min("v1_date").alias("first_date")).filter(F.col("df") >= b.cfg.min_total_freq)


@query("plural_edges", with_(_PLURAL, "", {"tm": _SURFACE}))
def _(b: Baskets) -> DataFrame:
    return merges.plural_edges(_surface_terms(b))


_DEFINING = r"""SELECT doc_id AS id, DATE '2016-01-01' + CAST(doc_id % 3650 AS INT) AS v1_date, text || CASE WHEN len(w) >= 3 THEN ' . In ' || w[1] || ' ' || w[2] || ' ' || w[3] || ' (' || upper(left(w[1], 1) || left(w[2], 1) || left(w[3], 1)) || 's) we see' ELSE '' END AS text
    FROM (SELECT *, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents)"""
_PAIRS = {
    "df": _DEFINING,
    "hit": rf"""SELECT id, v1_date, rtrim(lower(s), 's') AS short, string_split(trim(regexp_replace(lower(l), '\s+', ' ', 'g')), ' ') AS w FROM (SELECT id, v1_date, unnest(regexp_extract_all(text, '{merges.DEFINITION}', 1)) AS l, unnest(regexp_extract_all(text, '{merges.DEFINITION}', 2)) AS s FROM df)""",
    "ap": "SELECT id, v1_date, short, array_to_string(w[len(w) - length(short) + 1:], ' ') AS long FROM hit WHERE length(short) >= 3 AND len(w) BETWEEN 2 AND 6 AND len(w) >= length(short) AND array_to_string([left(x, 1) for x in w[len(w) - length(short) + 1:]], '') = short",
}


@query("acronym_pairs", with_("SELECT * FROM ap", "", _PAIRS))
def _(b: Baskets) -> DataFrame:
    return merges.acronym_pairs(b.defining)


_SINGULAR = r"""CASE WHEN length(l) >= 4 AND l LIKE '%ies' THEN regexp_replace(l, 'ies$', 'y') WHEN length(l) >= 4 AND regexp_matches(l, '(ses|xes|zes|ches|shes)$') THEN regexp_replace(l, 'es$', '')
    WHEN length(l) >= 4 AND l LIKE '%s' AND NOT regexp_matches(l, '(ss|us|is)$') THEN regexp_replace(l, 's$', '') ELSE l END"""


@query("acronym_edges", with_("""SELECT short, long, effective_date, n::BIGINT AS n, round(share, 6) AS share FROM (SELECT short, max_by(long, (n, long)) AS long, min(first) AS effective_date, sum(n) AS n, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY short) AS share
    FROM (SELECT short, long, """ + _spelled("regexp_extract(long, '^(.*?)[^ ]+$', 1) || " + f"(SELECT {_SINGULAR} FROM (SELECT string_split(long, ' ')[-1] AS l))") + """ AS key, count(*) AS n, min(v1_date) AS first FROM ap GROUP BY ALL) GROUP BY short, key) WHERE n >= 2 AND share >= 0.7""", "", _PAIRS))
def _(b: Baskets) -> DataFrame:
    return merges.acronym_edges(merges.acronym_pairs(b.defining), least=2).select("short", "long", "effective_date", "n", *r6("share"))


#: Edges of the merge map: spelling variants are timeless, plurals are dated by their member's first occurrence.
_EDGES = {
    "sv": _VARIANT, "pe": _PLURAL,
    "fd": r"""SELECT cand, min(DATE '2016-01-01' + CAST(doc_id % 3650 AS INT)) AS first_date FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(translate(text, '‐‑‒–—−', '------')), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[-''’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*){0,30}'))) AS cand FROM documents) GROUP BY 1""",
    "ee": "SELECT member AS a, canonical AS b, DATE '1900-01-01' AS d FROM sv UNION ALL SELECT member, canonical, first_date FROM pe JOIN fd ON fd.cand = member",
    "bo": "SELECT a, b FROM ee UNION SELECT b, a FROM ee",
    "rc": "SELECT a AS node, a AS o FROM bo UNION SELECT rc.node, bo.b FROM rc JOIN bo ON bo.a = rc.o",
    "rt": "SELECT node, min(o) AS root FROM rc GROUP BY 1",
    "cl": "SELECT node AS cand, first_value(node) OVER (PARTITION BY root ORDER BY df DESC, node) AS cluster, df FROM rt JOIN tm ON tm.cand = node",
    "ed": "SELECT c, min(d) AS d FROM (SELECT a AS c, d FROM ee UNION ALL SELECT b, d FROM ee) GROUP BY 1",
    "mg": "SELECT cl.cand, cluster, CASE WHEN cl.cand = cluster THEN DATE '1900-01-01' ELSE d END AS effective_date, df FROM cl JOIN ed ON c = cl.cand",
}


def _merged(b: Baskets) -> tuple[DataFrame, DataFrame]:
    terms = _surface_terms(b)
    variants = merges.string_variants(terms).select(F.col("member").alias("a"), F.col("canonical").alias("b"), F.to_date(F.lit(merges.TIMELESS)).alias("effective_date"))
    dated = terms.select(F.col("cand").alias("member"), F.col("first_date").alias("effective_date"))
    plurals = merges.plural_edges(terms).join(dated, "member").select(F.col("member").alias("a"), F.col("canonical").alias("b"), "effective_date")
    return merges.merge_map(terms, variants.union(plurals)), terms


@query("merge_clusters", with_("SELECT * FROM mg", "", {"tm": _SURFACE} | _EDGES, recursive=True))
def _(b: Baskets) -> DataFrame:
    return _merged(b)[0]


@query("merge_flags", with_("""SELECT cluster, count(*) AS n_members, round(max(abs(date_diff('day', k.first_date, f.first_date)) / 365.25), 6) AS max_gap_years, max(abs(date_diff('day', k.first_date, f.first_date)) / 365.25) > 3 AS gap_flag, count(*) > 6 AS oversize_flag
    FROM mg JOIN fd f USING (cand) JOIN fd k ON k.cand = cluster GROUP BY 1""", "", {"tm": _SURFACE} | _EDGES, recursive=True))
def _(b: Baskets) -> DataFrame:
    merged, terms = _merged(b)
    return merges.merge_flags(merged, terms).select("cluster", "n_members", *r6("max_gap_years"), "gap_flag", "oversize_flag")


def _order_suppliers(lines: DataFrame) -> DataFrame:
    return label_components(lines.select(F.col("l_orderkey").cast("string").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


# Recursion over the whole table is too slow for SQL; a test holds this against union-find.
@query("union_components")
def _(b: Baskets) -> DataFrame:
    return _order_suppliers(b.read("lineitem"))


@query("ingest_drop_reasons", """WITH r AS (SELECT doc_id AS id, lang || ' ' || source AS categories, text AS abstract, CASE WHEN doc_id % 17 = 0 THEN 'Withdrawn by the author' END AS comments,
    DATE '2016-01-01' + CAST(doc_id % 3650 AS INT) AS day FROM documents) SELECT coalesce(reason, 'kept') AS drop_reason, count(*) AS n FROM (SELECT CASE WHEN NOT (categories LIKE 'en %' OR categories LIKE 'fr %') THEN 'category'
    WHEN comments IS NOT NULL THEN 'withdrawn' WHEN id % 23 = 0 THEN 'no_date' WHEN day > DATE '2017-12-31' THEN 'after_cutoff' WHEN trim(abstract) = '' THEN 'empty_abstract' END AS reason FROM r) GROUP BY 1""")
def _(b: Baskets) -> DataFrame:
    day = F.date_add(F.lit("2016-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(3650)).cast("int"))
    records = b.read("documents").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("abstract"), F.concat_ws(" ", "lang", "source").alias("categories"),
        F.when(F.col("doc_id") % 17 == 0, "Withdrawn by the author").alias("comments"), F.when(F.col("doc_id") % 23 != 0, F.concat(F.lit("Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 10:00:00 GMT"))).alias("created"),
    )
    return corpus.drop_reason(records, ["en", "fr"], "2017-12-31").groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("paper_text", r"""SELECT conv_id, turn, CASE WHEN h = '' THEN t WHEN t = '' THEN h ELSE h || '. ' || t END AS text FROM (SELECT conv_id, turn, regexp_replace(role || ' .', '[ .]+$', '') AS h, coalesce(text, '') AS t FROM conversations)""")
def _(b: Baskets) -> DataFrame:
    return b.read("conversations").select("conv_id", "turn", text.paper_text(F.concat("role", F.lit(" .")), F.col("text")).alias("text"))


@query("papers", """SELECT id, title, abstract, primary_category, lang_en, n_authors, array_to_string(authors, '|') AS authors, v1_date, year(v1_date)::INT AS v1_year, quarter(v1_date)::INT AS v1_quarter, n_versions FROM (SELECT doc_id::VARCHAR AS id, 't ' || source AS title, trim(regexp_replace(text, '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g')) AS abstract, lang AS primary_category, lang = 'en' AS lang_en, 2 AS n_authors,
    ['ann ' || lang, lower(source)] AS authors, DATE '2016-01-01' + CAST(doc_id % 3650 AS INT) AS v1_date, (doc_id % 3 + 1)::INT AS n_versions FROM documents WHERE doc_id % 23 <> 0 AND lang IN ('en', 'fr')) WHERE abstract <> ''""".replace("\\\\", "\\"))
def _(b: Baskets) -> DataFrame:
    day = F.date_add(F.lit("2016-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(3650)).cast("int"))
    records = b.read("documents").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit(" t  "), "source").alias("title"), F.col("text").alias("abstract"), F.concat_ws(" ", "lang", "source").alias("categories"), F.lit(None).cast("string").alias("comments"),
        F.when(F.col("doc_id") % 23 != 0, F.concat(F.lit("Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 10:00:00 GMT"))).alias("created"), F.array(F.concat(F.lit("Ann  "), "lang"), F.upper("source")).alias("authors"), (F.col("doc_id") % 3 + 1).alias("n_versions"),
    )
    out = corpus.papers(records, ["en", "fr"], "2030-01-01", {"lang_en": "en"})
    return out.select("id", "title", "abstract", "primary_category", "lang_en", "n_authors", F.array_join("authors_parsed", "|").alias("authors"), "v1_date", F.col("v1_year").cast("int").alias("v1_year"), F.col("v1_quarter").cast("int").alias("v1_quarter"), F.col("n_versions").cast("int").alias("n_versions"))


@query("strip_markup")
def _(b: Baskets) -> DataFrame:
    return b.read("documents").select("doc_id", text.strip_markup(F.concat(F.lit(r"\emph{\textbf{deep}} net $x^2$ \cite{a} \alpha "), F.col("text"))).alias("text"))


# --- judge ------------------------------------------------------------------------------------------------------------

_LINES = "SELECT (l_orderkey % 50)::INT AS batch, CASE l_linenumber % 3 WHEN 0 THEN l_orderkey || ' keep' WHEN 1 THEN l_orderkey || ', DROP' ELSE 'not a verdict' END AS value FROM lineitem"


def _verdict_lines(rows: DataFrame) -> DataFrame:
    k = F.col("l_orderkey").cast("string")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.concat(k, F.lit(" keep"))).when(F.col("l_linenumber") % 3 == 1, F.concat(k, F.lit(", DROP"))).otherwise("not a verdict")
    return rows.select((F.col("l_orderkey") % 50).cast("int").alias("batch"), value.alias("value"))


def _verdict_counts(rows: DataFrame) -> DataFrame:
    return judge.parse_verdicts(_verdict_lines(rows)).groupBy("batch", "malformed", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("judge_ingest", with_("SELECT batch, malformed, verdict, count(*) AS n FROM (SELECT batch, NOT regexp_matches(value, '(?i)^\\s*(\\d+)\\s*[\\t,: ]\\s*(KEEP|DROP)\\s*$') AS malformed, nullif(upper(regexp_extract(value, '(?i)(KEEP|DROP)\\s*$', 1)), '') AS verdict FROM li) GROUP BY ALL", "", {"li": _LINES}))
def _(b: Baskets) -> DataFrame:
    return _verdict_counts(b.read("lineitem"))


@query("judge_attach", """SELECT 't' || i.l_orderkey || '-' || l_linenumber AS term, verdict, verdict IS NULL AS missing FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) i LEFT JOIN
    (SELECT l_orderkey % 50 AS batch, l_orderkey, min(CASE WHEN l_linenumber % 3 = 1 THEN 'DROP' ELSE 'KEEP' END) AS verdict FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY ALL) v ON v.l_orderkey = i.l_orderkey""")
def _(b: Baskets) -> DataFrame:
    index = b.read("lineitem").select((F.col("l_orderkey") % 50).cast("int").alias("batch"), F.col("l_orderkey").cast("int").alias("line"), F.concat(F.lit("t"), "l_orderkey", F.lit("-"), "l_linenumber").alias("term")).distinct()
    return judge.attach_verdicts(index, judge.parse_verdicts(_verdict_lines(b.read("lineitem"))))


@query("judge_filter", with_("SELECT DISTINCT term FROM lt WHERE length(term) % 5 <> 0", "lt"))
def _(b: Baskets) -> DataFrame:
    terms = b.events.select("term").distinct()
    verdicts = terms.select("term", F.when(F.length("term") % 5 == 0, "DROP").when(F.length("term") % 5 == 1, "KEEP").alias("verdict"))
    return judge.keep_unless_dropped(terms, verdicts)


@query("judge_audit",
    with_("", SERIES + " cry dec cens").rstrip() + ", " + _REG + """ SELECT stratum, n_persisted, n_declined, round(CASE WHEN n_persisted >= 1 AND n_declined >= 1 THEN kp - kd END, 6) AS gap FROM (SELECT CASE WHEN total_papers < 26 THEN '9-25' WHEN total_papers < 61 THEN '26-60' WHEN total_papers < 151 THEN '61-150' WHEN total_papers < 501 THEN '151-500' ELSE '501+' END AS stratum,
    count(*) FILTER (fate = 'persisted') AS n_persisted, count(*) FILTER (fate LIKE '%declined') AS n_declined, avg((length(concept) % 2)::DOUBLE) FILTER (fate = 'persisted') AS kp, avg((length(concept) % 2)::DOUBLE) FILTER (fate LIKE '%declined') AS kd FROM reg GROUP BY 1)""")
def _(b: Baskets) -> DataFrame:
    verdicts = b.merge_map.select(F.col("cand").alias("term"), F.when(F.length("cand") % 2 == 1, "KEEP").otherwise("DROP").alias("verdict"))
    return judge.hindsight_audit(b.registry, verdicts, least=1).select("stratum", "n_persisted", "n_declined", *r6("gap"))


@query("keep_rate_pivot", "SELECT d.lang, round(avg(quality) FILTER (toxic = 0), 6) AS clean, round(avg(quality) FILTER (toxic = 1), 6) AS toxic FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def _(b: Baskets) -> DataFrame:
    rows = b.read("labels").join(b.read("documents").select("doc_id", "lang"), "doc_id")
    out = rows.groupBy("lang").pivot("toxic", [0, 1]).agg(F.avg("quality"))
    return out.select("lang", F.round("0", 6).alias("clean"), F.round("1", 6).alias("toxic"))


# --- models -----------------------------------------------------------------------------------------------------------


def _yearly_units(b: Baskets) -> DataFrame:
    """(region_id, node, year): papers this year and last, and the births target: papers of the next year."""
    s = registry.series(b.labels)
    last = s.select("concept", (F.col("year") + 1).alias("year"), F.col("n_papers").alias("n_last"))
    after = s.select("concept", (F.col("year") - 1).alias("year"), F.col("n_papers").alias("n_next"))
    return s.join(last, ["concept", "year"]).join(after, ["concept", "year"]).filter(F.col("year") <= 1999)


_YEARLY = {
    "yu": "SELECT s.concept, s.year, s.n, l.n AS n_last, x.n AS n_next FROM ls s JOIN ls l ON l.concept = s.concept AND l.year = s.year - 1 JOIN ls x ON x.concept = s.concept AND x.year = s.year + 1 WHERE s.year <= 1999",
    "yg": "SELECT *, CASE WHEN n_last > 1 THEN n::DOUBLE / n_last END AS growth FROM yu",
    "ym": "SELECT median(growth) AS m, quantile_cont(coalesce(growth, NULL), 0.99) AS p FROM yg WHERE year <= 1997",
    "yw": "SELECT concept, year, least(coalesce(growth, m), p) AS g FROM yg, ym",
    "yz": "SELECT avg(g) AS a, stddev_samp(g) AS s FROM yw WHERE year <= 1997",
}


@query("model_prepare", with_("SELECT concept, year, round(coalesce((g - a) / nullif(s, 0), 0), 5) AS growth FROM yw, yz", "pp lt ev lb ls", _YEARLY))
def _(b: Baskets) -> DataFrame:
    rows = _yearly_units(b).withColumn("growth", F.when(F.col("n_last") > 1, F.col("n_papers") / F.col("n_last")))
    return models.prepare(rows, ["growth"], F.col("year") <= 1997).select("concept", "year", F.round("growth", 5).alias("growth"))


@query("log_score_null", with_("SELECT round(sum(n_next * ln(greatest(r * n, 1e-9)) - greatest(r * n, 1e-9)), 4) AS log_score, round(sum(n_next) / sum(r * n), 6) AS calibration FROM yu, (SELECT sum(n_next)::DOUBLE / sum(n) AS r FROM yu WHERE year <= 1997) WHERE year > 1997", "pp lt ev lb ls", _YEARLY))
def _(b: Baskets) -> DataFrame:
    rows = _yearly_units(b)
    rate = rows.filter("year <= 1997").agg((F.sum("n_next") / F.sum("n_papers")).alias("r")).scalar()
    scored = rows.filter("year > 1997").withColumn("mu", rate * F.col("n_papers"))
    return scored.agg(F.round(F.sum(models.log_score(F.col("n_next"), F.col("mu"))), 4).alias("log_score"), F.round(F.sum("n_next") / F.sum("mu"), 6).alias("calibration"))


@query("horizon_targets", with_("SELECT unit_id, h::INT AS horizon, origin::INT AS origin, round(coalesce(sum(mass), 0), 6) AS births_mass FROM (SELECT region_id AS unit_id, h, o AS origin FROM rs, range(1, 3) t(h), range(1996, 1999) u(o) WHERE o + h <= 1999) LEFT JOIN (SELECT unit_id, t, mass FROM att JOIN lw USING (concept)) USING (unit_id) WHERE t IS NULL OR t BETWEEN origin + 1 AND origin + h OR true GROUP BY ALL", "pp lt ev ky lb bk ls lw", _ATT).replace("sum(mass)", "sum(mass) FILTER (t BETWEEN origin + 1 AND origin + h)"))
def _(b: Baskets) -> DataFrame:
    births = b.label_births.select("concept", "crystallization_year")
    return models.resolvable_targets(b.blocks(), b.attached, births, [1996, 1997, 1998], [1, 2], 2000, b.cfg.m).select("unit_id", "horizon", "origin", *r6("births_mass"))


@query("bags", with_("SELECT paper_id, string_agg(concept, '|' ORDER BY concept) AS bag FROM (SELECT DISTINCT paper_id, concept FROM lb WHERE year <= 1997) GROUP BY 1", "pp lt ev lb"))
def _(b: Baskets) -> DataFrame:
    return models.bags(b.labels.filter(F.col("year") <= BEFORE)).select("paper_id", F.array_join("bag", "|").alias("bag"))


@query("scorers", with_("SELECT region_id, node, s.scorer, row_number() OVER (PARTITION BY region_id, s.scorer ORDER BY CASE s.scorer WHEN 'degree' THEN degree_in WHEN 'papers' THEN coalesce(n_t, 0) ELSE coalesce(n_t, 0) / greatest(1.0, n_t1) END DESC, node)::INT AS rank FROM ne LEFT JOIN pn USING (node), (SELECT unnest(['degree', 'papers', 'velocity']) AS scorer) s", "pp lt ev lb bk two", {n: _NODE[n] for n in (*window_ctes(ORIGIN), "bw", "pn", "co", "ne")}))
def _(b: Baskets) -> DataFrame:
    rows = evaluate.node_features(b.two(), b.labels, b.strong(ORIGIN), ORIGIN)
    return evaluate.scored_by(rows, {"degree": "degree_in", "papers": "n_t", "velocity": "velocity"}).select("region_id", "node", "scorer", "rank")


@query("poisson_ladder")
def _(b: Baskets) -> DataFrame:
    rows = _yearly_units(b).withColumn("growth", F.col("n_papers") / F.col("n_last")).withColumn("size", F.length("concept").cast("double"))
    rows = models.prepare(rows.withColumn("exposure", F.col("n_papers")), ["growth", "size"], F.col("year") <= 1997)
    return models.poisson_ladder(rows, {"growth": ["growth"], "growth_size": ["growth", "size"]}, "n_next", "exposure", F.col("year") <= 1997, F.col("year") > 1997)


@query("gbt_rank")
def _(b: Baskets) -> DataFrame:
    rows = _yearly_units(b).withColumn("up", (F.col("n_next") > F.col("n_papers")).cast("double")).withColumn("x", F.col("n_papers").cast("double")).withColumn("y", F.col("n_last").cast("double"))
    scored = models.boosted_scores(rows, ["x", "y"], "up", F.col("year") <= 1997)
    return evaluate.ranked(scored.filter("year = 1999").select(F.split("concept", " ")[1].alias("region_id"), F.col("concept").alias("node"), "score")).select("region_id", "node", "rank")


@query("word2vec_spread")
def _(b: Baskets) -> DataFrame:
    vectors = models.embed(models.bags(b.labels.filter(F.col("year") <= BEFORE)), partitions=4)
    return features.embedding_spread(vectors.select(F.split("concept", " ")[1].alias("region_id"), "vec"), "region_id")


@query("hypergeom_grid", """SELECT o, round((SELECT sum(CASE WHEN i > 12 OR 10 - i > 500 - 12 THEN 0 ELSE exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i) + lgamma(489) - lgamma(11 - i) - lgamma(479 + i) - lgamma(501) + lgamma(11) + lgamma(491)) END)
    FROM range(o, 11) t(i)), 9) AS p FROM range(1, 6) r(o)""")
def _(b: Baskets) -> DataFrame:
    o = b.spark.range(1, 6).select(F.col("id").alias("o"))
    return o.select("o", F.round(stats.hypergeom_tail(F.col("o"), F.lit(500), F.lit(12), F.lit(10)), 9).alias("p"))
