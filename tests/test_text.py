"""Markup, spelling, candidates, C-value, kills and merges on hand fixtures."""

from __future__ import annotations

import collections
import datetime as dt
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolex.functions import text
from chronolex.operators import corpus, judge, merges, termhood


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def slow_markup(text):
    """The rules said again with Python's own engine."""
    text = text.replace(r"\$", " ")
    text = re.sub(r"\\begin\s*\{([^{}]*)\}.*?\\end\s*\{\1\}", " ", text, flags=re.S)
    text = re.sub(r"\\(cite[a-zA-Z]*|ref|eqref|label|url|href|includegraphics|bibliography|footnote|autoref|pageref|nocite)\s*(\[[^\]]*\])?\s*\{[^{}]*\}", " ", text, flags=re.I)
    text = re.sub(r"\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]", " ", text, flags=re.S)
    for _ in range(3):
        text = re.sub(r"\\[a-zA-Z@]+\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", r" \1 ", text)
    text = re.sub(r"\\[a-zA-Z@]+\*?|\\\\|\\[^a-zA-Z\s]", " ", text)
    return " ".join(re.sub(r"[{}]", " ", text).split())


def test_markup_of_random_texts(spark):
    rng = random.Random(3)
    bits = [r"\$", "$", "$$", r"\(", r"\)", r"\[", r"\]", r"\begin{a}", r"\end{a}", r"\begin{b}", r"\end{b}", r"\emph{", r"\foo[o]{", "}", "{", r"\cite{k}", r"\citep[p]{k}", r"\Ref{x}", r"\alpha", r"\\", r"\%", r"\&", "word", "deep net", "\n", "x^2"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in frame.select("t", text.strip_markup(F.col("t")).alias("x")).collect()} == {t: slow_markup(t) for t in texts}


def test_tokens_lemmas_and_tags(spark):
    split = one(spark, text.tokens(F.col("t")), t="We saw dogs. Cats–ran (e.g. 3D-CNNs), it's 2024!")
    assert split == ["we", "saw", "dogs", ".", "cats-ran", "(", "e", ".", "g", ".", "3d-cnns", ")", ",", "it's", "2024", "!"]
    lemmas = {t: one(spark, text.lemma(F.col("t")), t=t) for t in ("dogs", "bodies", "classes", "analysis", "loss", "bus", "has", "this", "gas", "boxes", "paper's", "cases")}
    assert lemmas == {"dogs": "dog", "bodies": "body", "classes": "class", "analysis": "analysis", "loss": "loss", "bus": "bus", "has": "has", "this": "this", "gas": "gas", "boxes": "box", "paper's": "paper's", "cases": "case"}
    tags = {t: one(spark, termhood.tag(F.col("t")), t=t) for t in (",", "the", "2024", "quickly", "training", "self-supervised", "neural", "network", "3d")}
    assert tags == {",": "PUNCT", "the": "DET", "2024": "NUM", "quickly": "ADV", "training": "VERB", "self-supervised": "ADJ", "neural": "ADJ", "network": "NOUN", "3d": "NOUN"}


def plain_candidates(words, stop, most=5):
    """n-grams, runs between stop words and chunk suffixes of one tagged document, token by token."""
    segments, run = [], []
    for lemma, pos in [*words, (".", "PUNCT")]:
        if pos == "PUNCT":
            segments.append(run)
            run = []
        else:
            run.append((lemma, pos))
    grams = {" ".join(w for w, _ in s[i : i + n]) for s in segments for n in (2, 3) for i in range(len(s) - n + 1)}
    rake, chunks = set(), set()
    for s in segments:
        run = []
        for lemma, _ in [*s, (None, "")]:
            if lemma is None or lemma in stop:
                if 1 <= len(run) <= most:
                    rake.add(" ".join(run))
                run = []
            else:
                run.append(lemma)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                tags = [p for _, p in s[i:j]]
                k = next((x for x, p in enumerate(tags) if p == "NOUN"), len(tags))
                whole = all(p == "ADJ" for p in tags[:k]) and k < len(tags) and all(p == "NOUN" for p in tags[k:])
                if whole and j - i <= most and (j == len(s) or s[j][1] != "NOUN"):
                    chunks.add(" ".join(w for w, _ in s[i:j]))
    return grams, rake, chunks


def test_candidates_against_plain_code(spark):
    rng = random.Random(4)
    kinds = {"deep": "ADJ", "neural": "ADJ", "net": "NOUN", "model": "NOUN", "of": "DET", "the": "DET", "run": "VERB", ",": "PUNCT", "7": "NUM"}
    docs = [[(w := rng.choice(list(kinds)), kinds[w]) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    rows = [(i, [w for w, _ in d], [p for _, p in d], [w for w, _ in d]) for i, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "id int, lemmas array<string>, pos array<string>, words array<string>")
    found = [{(r.id, r.cand) for r in f.select("id", "cand").collect()} for f in (corpus.ngram_postings(frame, (2, 3), ("id",)), corpus.rake_phrases(frame), corpus.noun_chunks(frame))]
    expected = [set(), set(), set()]
    for i, d in enumerate(docs):
        for into, cands in zip(expected, plain_candidates(d, text.STOPWORDS), strict=True):
            into |= {(i, c) for c in cands}
    expected[0] = {(i, c) for i, c in expected[0] if re.search("[a-z]", c)}
    assert found == expected


def test_long_runs(spark):
    long = spark.createDataFrame([(1, ["net"] * 30_000, ["NOUN"] * 30_000), (2, ["deep"] * 30_000 + ["net"], ["ADJ"] * 30_000 + ["NOUN"])], "id int, lemmas array<string>, pos array<string>")
    assert {(r.id, len(r.cand.split())) for r in corpus.noun_chunks(long).collect()} == {(i, n) for i in (1, 2) for n in range(1, 6)}
    assert len(one(spark, text.tokens(F.col("t")), t="a-" * 40_000)) > 40_000 / 31


def test_grams_end_with_segments(spark):
    words = spark.createDataFrame([(1, ["we", "saw", "dog", ".", "cat", "ran", "2", "2"])], "id int, words array<string>")
    assert cands(corpus.ngram_postings(words, (1, 2, 3), ("id",))) == {"we", "saw", "dog", "we saw", "saw dog", "we saw dog", "cat", "ran", "cat ran", "ran 2", "cat ran 2", "ran 2 2"}


def test_ledger_of_both_passes(spark):
    day = dt.date(2001, 1, 1)
    words = spark.createDataFrame([(1, day, "a b c d e".split()), (2, day, "b c d e f".split())], "id int, v1_date date, words array<string>")
    masks = spark.createDataFrame([("a", 1), ("b c", 2), ("b c d e", 3), ("x", 1)], "cand string, src_mask int")
    found = {r.cand: (r.df, r.n_tokens, r.src_mask) for r in corpus.ledger(corpus.postings(words, masks), masks).collect()}
    assert found == {"a": (1, 1, 1), "b c d e": (2, 4, 3), "b c": (2, 2, 6), "a b": (1, 2, 4), "c d": (2, 2, 4), "d e": (2, 2, 4), "e f": (1, 2, 4), "a b c": (1, 3, 4), "b c d": (2, 3, 4), "c d e": (2, 3, 4), "d e f": (1, 3, 4)}


def test_markup(spark):
    assert one(spark, text.strip_markup(F.col("t")), t=r"\emph{\textbf{deep}} net $x^2$ \cite{a} \alpha") == "deep net"
    assert one(spark, text.strip_markup(F.col("t")), t="a \\begin{eq}x\n\\end{eq} b") == "a b"


def test_paper_text(spark):
    assert one(spark, text.paper_text(F.col("a"), F.col("b")), a="Title. .", b="Body") == "Title. Body"
    assert one(spark, text.paper_text(F.col("a"), F.col("b")), a="", b="Body") == "Body"


@pytest.mark.parametrize(("name", "expected"), [("gans", "gan"), ("bodies", "body"), ("classes", "class"), ("analysis", None), ("loss", None), ("bus", None), ("gas", None), ("neural networks", "neural network")])
def test_singular(spark, name, expected):
    assert one(spark, text.singular(F.col("t")), t=name) == expected


def test_variants_share_a_normal_form(spark):
    assert len({one(spark, text.normal_form(F.col("t")), t=t) for t in ("pre-train", "pre train", "pretrain")}) == 1
    assert one(spark, text.normal_form(F.col("t")), t="optimisation") == "optimization"


def test_dates(spark):
    assert one(spark, text.first_date(F.col("t")), t="Mon, 2 Apr 2007 19:18:42 GMT") == dt.date(2007, 4, 2)
    assert one(spark, text.first_date(F.col("t")), t="nothing") is None


def tagged(spark, tokens):
    words, tags = zip(*[t.rsplit("/", 1) for t in tokens.split()], strict=True)
    return spark.createDataFrame([(1, list(words), list(tags))], "id int, lemmas array<string>, pos array<string>")


def cands(frame):
    return {r.cand for r in frame.collect()}


def test_chunks(spark):
    assert cands(corpus.noun_chunks(tagged(spark, "deep/ADJ convolutional/ADJ neural/ADJ network/NOUN"))) == {"network", "neural network", "convolutional neural network", "deep convolutional neural network"}
    assert cands(corpus.noun_chunks(tagged(spark, "large/ADJ"))) == set()
    assert cands(corpus.noun_chunks(tagged(spark, "net/NOUN ,/PUNCT deep/ADJ model/NOUN"))) == {"net", "model", "deep model"}


def test_rake(spark):
    assert cands(corpus.rake_phrases(tagged(spark, "range/NOUN of/DET deep/ADJ nets/NOUN ,/PUNCT and/DET graphs/NOUN"))) == {"range", "deep nets", "graphs"}


def test_ledger(spark):
    rows = [(1, dt.date(2001, 1, 1), "a b"), (2, dt.date(2000, 1, 1), "a b"), (3, dt.date(2000, 1, 1), "a b")]
    out = corpus.ledger(spark.createDataFrame(rows, "id int, v1_date date, cand string")).first()
    assert (out.df, out.first_date, out.first_paper_id, out.n_tokens) == (3, dt.date(2000, 1, 1), 2, 2)


def test_short_documents_have_no_grams(spark):
    words = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "b"])], "id int, words array<string>")
    assert {(r.id, r.cand) for r in corpus.ngram_postings(words, (2, 3), ("id",)).collect()} == {(3, "a b")}


def test_c_value(spark):
    terms = spark.createDataFrame([("network", 12), ("neural network", 10), ("convolutional neural network", 4)], "cand string, df int")
    found = {r.cand: (round(r.c_value, 9), r.n_containers) for r in termhood.c_value(terms).collect()}
    assert found == {"network": (5.0, 2), "neural network": (9.509775004, 1), "convolutional neural network": (8.0, 0)}


def test_kills(spark):
    names = {"propose method": "verb_led", "first stage": "ordinal", "range of camera": "stopword_straddler", "novel": "non_nominal_head", "model": "generic_head", "diffusion model": "keep", "": "empty"}
    pos = spark.createDataFrame([("propose", "VERB"), ("novel", "ADJ"), ("model", "NOUN"), ("stage", "NOUN")], "lemma string, dominant_pos string")
    found = termhood.kill_reasons(spark.createDataFrame([(n,) for n in names], "cand string"), pos)
    assert {r.cand: r.kill_reason for r in found.collect()} == names


def test_acronyms(spark):
    long = ["convolutional neural networks"] * 3 + ["convolutional neural network"] * 2 + ["cable news network"]
    rows = [(i, dt.date(2015, 1, 1 + i), f"{x} ({short}) here.") for i, (x, short) in enumerate(zip(long, ["CNN", "CNNs", "CNN", "CNN", "CNN", "CNN"], strict=True))]
    rows += [(10, dt.date(2015, 2, 1), "convolutional neural networks (cnn) and a very long clause that has far too many words (TMW)")]
    pairs = merges.acronym_pairs(spark.createDataFrame(rows, "id int, v1_date date, text string"))
    (edge,) = merges.acronym_edges(pairs).collect()
    assert (edge.short, edge.long, edge.n, edge.effective_date) == ("cnn", "convolutional neural networks", 5, dt.date(2015, 1, 1))


def test_merge_map_keeps_the_evidence_date(spark):
    names = spark.createDataFrame([("gan", 100), ("generative adversarial network", 50)], "cand string, df int")
    edges = spark.createDataFrame([("gan", "generative adversarial network", dt.date(2015, 6, 18))], "a string, b string, effective_date date")
    found = {r.cand: (r.cluster, r.effective_date) for r in merges.merge_map(names, edges).collect()}
    assert found == {"gan": ("gan", dt.date(1900, 1, 1)), "generative adversarial network": ("gan", dt.date(2015, 6, 18))}


def test_ingest_order_of_reasons(spark):
    day = "Mon, 2 Apr 2007 19:18:42 GMT"
    rows = [
        (0, "a", "x", "text", "cs.CL cs.AI", None, day), (1, "a", "x", "text", "cs.CL", None, day), (2, "b", "x", "text", "math", None, day), (3, "c", "x", "text", "cs.CL", "Withdrawn", day),
        (4, "d", "x", "text", "cs.CL", None, "?"), (5, "e", "x", "text", "cs.CL", None, "1 Jan 2030"), (6, "f", "x", " ", "cs.CL", None, day), (7, "", "x", "text", "cs.CL", None, day),
    ]
    found = corpus.drop_reason(spark.createDataFrame(rows, "pos int, id string, title string, abstract string, categories string, comments string, created string"), ["cs.CL"], "2020-01-01")
    assert {r.pos: r.drop_reason for r in found.collect()} == {0: None, 1: "duplicate", 2: "category", 3: "withdrawn", 4: "no_date", 5: "after_cutoff", 6: "empty_abstract", 7: "duplicate"}


def test_verdict_lines(spark):
    lines = spark.createDataFrame([(1, "3\tkeep"), (1, " 4 : DROP "), (1, "maybe"), (1, ""), (1, "4 KEEP")], "batch int, value string")
    parsed = judge.parse_verdicts(lines)
    assert [(r.line, r.verdict, r.malformed) for r in parsed.orderBy("line", "verdict").collect()] == [(None, None, True), (3, "KEEP", False), (4, "DROP", False), (4, "KEEP", False)]
    index = spark.createDataFrame([(1, 3, "t3"), (1, 4, "t4"), (1, 5, "t5")], "batch int, line int, term string")
    assert {r.term: (r.verdict, r.missing) for r in judge.attach_verdicts(index, parsed).collect()} == {"t3": ("KEEP", False), "t4": ("DROP", False), "t5": (None, True)}


def test_hindsight_audit(spark):
    rows = [("p", "persisted", 30, k) for k in [True] * 60 + [False] * 40] + [("d", "crystallized_then_declined", 30, k) for k in [True] * 20 + [False] * 20] + [("e", "crystallized_then_declined", 200, True)] * 5
    births = spark.createDataFrame([(f"{i}", f, n) for i, (_, f, n, _) in enumerate(rows)], "concept string, fate string, total_papers int")
    verdicts = spark.createDataFrame([(f"{i}", "KEEP" if k else "DROP") for i, (_, _, _, k) in enumerate(rows)], "term string, verdict string")
    found = {r.stratum: (r.gap and round(r.gap, 6), r.flagged) for r in judge.hindsight_audit(births, verdicts).collect()}
    assert found == {"26-60": (0.1, True), "151-500": (None, False)}


def test_gram_counts_and_pieces(spark, monkeypatch):
    rng = random.Random(8)
    docs = [[rng.choice(["net", "é", "7", ",", None, "of"]) for _ in range(rng.randrange(9))] for _ in range(50)]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(docs)] + [(99, None)], "id int, words array<string>")
    of = lambda w: {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if not {",", None} & set(w[i : i + n]) and {"net", "é", "of"} & set(w[i : i + n])}
    expected = collections.Counter(g for w in docs for g in of(w))
    assert {r.cand: r.df for r in corpus.ngram_counts(frame, (1, 2, 3)).collect()} == expected
    monkeypatch.setattr(corpus, "MOST_WORDS", 10)
    batch = pa.RecordBatch.from_pydict({"words": pa.array(docs, pa.list_(pa.string()))})
    pieces = list(corpus._slices([batch]))
    found = collections.Counter(names[p].as_py() for piece in pieces for names, place, _ in corpus._gram_places(piece.column("words"), (1, 2, 3)) for p in place)
    assert len(pieces) > 10 and found == expected


def test_ledger_of_one_pass_is_that_of_both(spark):
    rows = [(-3, dt.date(1960, 5, 1), "a b c d e".split()), (2**62, dt.date(1960, 5, 1), "b c d e f".split()), (5, dt.date(1959, 1, 1), ["f"])]
    words = spark.createDataFrame(rows, "id long, v1_date date, words array<string>")
    masks = spark.createDataFrame([("a", 1), ("f", 1), ("b c", 2), ("b c d e", 3), ("x", 1)], "cand string, src_mask int")
    both, one = corpus.ledger(corpus.postings(words, masks), masks), corpus.ledger(corpus.all_postings(words), masks, (2, 3))
    assert sorted(both.collect()) == sorted(one.collect()) and one.columns == both.columns
    first = {r.cand: (r.first_date, r.first_paper_id) for r in one.collect()}
    assert first["f"] == (dt.date(1959, 1, 1), 5) and first["b c"] == (dt.date(1960, 5, 1), -3) and first["e f"] == (dt.date(1960, 5, 1), 2**62)
    assert "SortAggregate" not in corpus.ledger(corpus.all_postings(words))._jdf.queryExecution().toString()
    yearly = [{tuple(r) for r in f.collect()} for f in (corpus.ledger_yearly(corpus.postings(words, masks)), corpus.ledger_yearly(corpus.all_postings(words), masks))]
    assert yearly[0] == yearly[1]


def test_definitions_are_looked_for_at_brackets(spark):
    rng = random.Random(12)
    bits = ["deep neural net", "Large Language Model ", "a-b c", " ", "\t\n   ", "(", "(DNN)", "( LLMs )", "(llm)", "(A1-b)", "(TOOLONGNAME12)", ")", ".", "é", "x" * 90, " word" * 20, "ab", "(LM", "s)"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(600)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    every = lambda g: F.regexp_extract_all("t", F.lit(merges.DEFINITION), F.lit(g))
    squeezed = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"\s+", " "))
    near = merges.definitions(F.col("t"))
    taken = lambda g: F.transform(F.filter(near, lambda x: x.rlike(merges.DEFINITION)), lambda x: F.regexp_extract(x, merges.DEFINITION, g))
    rows = frame.select("t", *[squeezed(f(g)).alias(f"{n}{g}") for n, f in (("e", every), ("n", taken)) for g in (1, 2)]).collect()
    assert sum(len(r.e2 or []) for r in rows) > 100
    assert [(r.t, r.n1, r.n2) for r in rows] == [(r.t, r.e1, r.e2) for r in rows]


def test_c_value_reads_its_terms_once(spark):
    terms = spark.createDataFrame([("a b", 4), ("a", 9)], "cand string, df long")
    out = termhood.c_value(terms)
    assert {r.cand: r.n_containers for r in out.collect()} == {"a b": 0, "a": 1}
    assert all("/chronolex-" in f for f in out.inputFiles()) and out.inputFiles()
