"""Tokens, shards, mixes, quality, markup, media and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from chronolex.llm import bpe, html_text, media, mixing, quality, sharding
from chronolex.llm.common import Workspace

from tests.llm.cases import documents, empty, rows_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


# --- tokens -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    return bpe.ByteBPE(PATH, PATTERN, memo=500), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_every_latin_character_splits_alike(coders):
    own, other = coders
    for c in map(chr, range(ord(bpe.LATIN_END))):
        for text in (c, f"a{c}1", f" {c} b", f"!{c}{c}'s", f"  {c}  "):
            assert own.encode(text) == other.encode_ordinary(text)


def test_random_texts(coders):
    own, other = coders
    rng = random.Random(3)
    bits = ["a", "aa", " ", "  ", "b", "_", "\n", "é", "1", "'s", "!", "²", "\x1c", "\x85", "\xa0", "ß", "漢字", "한", "😀", "́"]
    for k in range(3000):
        text = "".join(rng.choice(bits[: 16 if k % 2 else None]) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert own.shortcuts and PATTERN == bpe.KNOWN
    words = bpe.ByteBPE(PATH, r"\p{L}+|\P{L}+")
    theirs = tiktoken.Encoding("words", pat_str=r"\p{L}+|\P{L}+", mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert not words.shortcuts and all(words.encode(t) == theirs.encode_ordinary(t) for t in ("a b  c", "é1 _x", "漢字 a" * 20_000))
    long = " ".join(rng.choice(["漢字", "かな", "abc", " ", "\n", "한글"]) for _ in range(70_000))
    assert len(list(bpe.parts(long))) > 1 and own.encode(long) == other.encode_ordinary(long)


def test_round_trip_and_offsets(spark, coders):
    docs = documents(spark)
    texts = Counter((r["doc_id"], r["text"] or "") for r in rows_of(docs))
    expected = Counter()
    for (doc_id, text), n in texts.items():
        ids = coders[1].encode_ordinary(text)
        expected[doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()] += n
    assert Counter(tuple(r.values()) for r in rows_of(bpe.round_trip(docs, PATH, PATTERN))) == expected
    coded = bpe.encode_texts(docs.filter("doc_id = 3"), PATH, PATTERN)
    row, back = coded.first(), bpe.decode_ids(coded, PATH, PATTERN).first()
    assert bytes(back.text_bytes).decode() == docs.filter("doc_id = 3").first().text
    assert row.starts[0] == 0 and len(row.starts) == len(row.ids)
    clash = bpe.encode_texts(docs.select(F.col("doc_id").alias("ids"), "text"), PATH, PATTERN, key="ids")
    assert clash.columns == ["key_ids", "ids", "starts"] and clash.count() == docs.count()
    assert bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0


# --- shards -----------------------------------------------------------------------------------------------------------


def test_differencing_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    bins = sharding.differencing([[s] for s in sizes], 7)
    sums = Counter()
    for s, (b,) in zip(sizes, bins, strict=True):
        sums[b] += s
    assert len(sums) == 7 and max(sums.values()) - min(sums.values()) <= 5
    assert sharding.differencing([[9], [1], [1]], 2) == [[0], [1], [1]]
    assert sharding.differencing([], 3) == []


@pytest.mark.parametrize("groups", [20_000, 3])
def test_shards(spark, monkeypatch, groups):
    monkeypatch.setattr(sharding, "GROUPS", groups)
    monkeypatch.setattr(sharding, "FAN", 4)
    docs = documents(spark)
    found = rows_of(sharding.balanced_shards(docs, 5))
    by_doc = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == by_doc
    slots, home = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        home[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(s) == 1 for s in home.values())
    assert sharding.balanced_shards(empty(spark)).count() == 0


# --- mixes ------------------------------------------------------------------------------------------------------------


def slow_targets(sizes: dict, weights, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in rows_of(mixing.mix_amounts(docs))}
    sizes, taken = Counter(), Counter()
    for i, text, source in rows:
        n = len(text.split())
        assert found[i]["size"] == n and found[i]["taken"] <= 2 * n
        sizes[source] += n
        taken[source] += found[i]["taken"]
    targets = slow_targets(sizes, (5, 2, 1))
    for i, _, source in rows:
        assert found[i]["source_size"] == sizes[source] and found[i]["target"] == pytest.approx(targets[source])
    assert all(abs(taken[s] - targets[s]) <= 0.08 * targets[s] + 256 for s in sizes)
    assert found == {r["doc_id"]: r for r in rows_of(mixing.mix_amounts(docs.repartition(5)))}


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        out = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()]
        assert sorted(out) == list(range(n)) and (n < 100 or out != sorted(out))


def spark_hash(*values):
    """xxhash64 of Spark: each value is hashed with the last result as the seed, nulls are left out; 32-bit numbers as 32 bits."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxh64_intdigest(v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def slow_permuted(at, n, *key):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash(*key, (r, "i")) % n - at) % n
        if spark_hash(*key, (r, "i"), (max(at, other), "l")) & 1:
            at = other
    return at


def test_taken_words_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rng = random.Random(8)
    rows = [(rng.choice([i, i, None]), " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 900))), rng.choice(["a", "a", "b", None])) for i in range(150)]
    found = Counter((r["doc_id"], r["size"], r["taken"]) for r in rows_of(mixing.mix_amounts(spark.createDataFrame(rows, "doc_id long, text string, source string"))))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    names, targets = sorted(sizes, key=lambda s: (s is None, s or "")), slow_targets(sizes, (5, 2, 1))
    n = {s: -(-sizes[s] // mixing.BLOCK) for s in names}
    amount = {s: min(2 * n[s], math.floor(targets[s] * n[s] / sizes[s] + 0.5)) for s in names}
    total, begin, shards, blocks, passes = sum(amount.values()), 0, Counter(), Counter(), defaultdict(set)
    for no, s in enumerate(names):
        for q in range(amount[s]):
            shards[slow_permuted(begin + q, total, (7, "i")) // 8, s] += 1
            block = slow_permuted(q % n[s], n[s], (7, "i"), (no, "i"), (q // n[s], "l"))
            blocks[s, block] += 1
            passes[s, q // n[s]].add(block)
        begin += amount[s]
    expected, texts = Counter(), Counter()
    for s in names:
        off = 0
        own = [(spark_hash((i, "l"), (t, "s"), (7, "i")), i, t) for i, t, x in rows if x == s]
        for _, i, t in sorted(own, key=lambda r: (r[0] % 64, r[0])):
            w = t.split()
            expected[i, len(w), sum(blocks[s, at // mixing.BLOCK] for at in range(off, off + len(w)))] += 1
            for p in (0, 1):
                if kept := [x for k, x in enumerate(w, off) if k // mixing.BLOCK in passes[s, p]]:
                    texts[i, s, " ".join(kept)] += 1
            off += len(w)
    assert found == expected
    mixed = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in rows_of(mixed)) == texts
    work = Workspace(spark, "t")
    table = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    drawn = mixing.slots(work.save("sources", table), per_shard=8).groupBy("shard", "source_no").count()
    assert {(r["shard"], names[r["source_no"]]): r["count"] for r in rows_of(drawn)} == dict(shards)
    assert max(sum(c for (x, _), c in shards.items() if x == y) for y in {x for x, _ in shards}) == 8


def test_mix_of_awkward_rows(spark):
    docs = documents(spark)
    found = rows_of(mixing.mix_amounts(docs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r["doc_id"], size(r["text"])) for r in rows_of(docs))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r["text"]) for r in rows_of(mixed)) == sum(r["taken"] for r in found)
    assert mixing.mix_amounts(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", "s")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in rows_of(mixing.mix_amounts(blank))] == [(0, 0, 0.0)] * 2


# --- quality ----------------------------------------------------------------------------------------------------------


def rated(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice("the of and net graph model data token shard media".split()) for _ in range(rng.randint(5, 60))]
        if kind == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["grukA", "grukBe", "grukly"]))
        if kind == 1:
            text = [t + "%%%" for t in text]
        out.append((" ".join(text), kind))
    return out


def test_ordinal_regression_on_held_out_rows():
    rng, features = random.Random(5), quality.Features()
    train, test = rated(rng, 800), rated(rng, 400)
    model = quality.fit([features.of(t) for t, _ in train], np.array([k for _, k in train]))
    assert (np.diff(model.thresholds) > 0).all() and (model.weights <= 0).all()
    score = np.array([model.weights[features.of(t)].sum(dtype=float) for t, _ in test])
    tails, truth = model.tails(score), np.array([k for _, k in test])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails[:, -1] >= 0.5) == (truth == 2)).mean() > 0.98
    assert np.corrcoef(model.expected(score), truth)[0, 1] > 0.8


def test_fit_is_the_best_of_all_weights():
    """The likelihood is concave: no random step from the fitted weights and thresholds, nor any plain search, does better."""
    rng = random.Random(7)
    rows, ratings = [], []
    for _ in range(300):
        own = sorted(rng.sample(range(4), rng.randint(0, 4)))
        score = 1.5 - 2.0 * (0 in own) - 0.7 * (1 in own) + 1.2 * (2 in own) + math.log(1 / rng.uniform(1e-9, 1 - 1e-9) - 1)
        rows.append(np.array(own, np.int32))
        ratings.append((score > 0) + (score > 2))

    def loss(weights, cuts):
        total = 0.0
        for own, k in zip(rows, ratings, strict=True):
            s = sum(weights[i] for i in own)
            above = [1.0, *(1 / (1 + math.exp(-(s - c))) for c in cuts), 0.0]
            total -= math.log(max(above[k] - above[k + 1], 1e-12))
        return total / len(rows)

    for most in (0.0, math.inf):
        model = quality.fit(rows, np.array(ratings), least_rows=1, least_z=0.0, most_weight=most)
        weights, cuts = [float(w) for w in model.weights[:4]], [float(c) for c in model.thresholds]
        own = loss(weights, cuts)
        for _ in range(400):
            step = rng.choice([0.02, 0.1, 0.5, 2])
            w, c = [min(most, x + rng.gauss(0, step)) for x in weights], sorted(x + rng.gauss(0, step) for x in cuts)
            assert loss(w, c) >= own - 2e-4
        assert all(w <= most for w in weights) and (most > 0 or weights[2] == 0)


def test_training_brings_only_telling_features_to_the_driver(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, text + "".join(f" own{i}x{j}" for j in range(200)), kind) for i, (text, kind) in enumerate(rated(rng, 600))]
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == 2), int(k == 0)) for i, _, k in rows], "doc_id long, quality int, toxic int")
    features, sizes, collect = quality.Features(), [], type(docs).toArrow
    slots = [features.of(text) for _, text, _ in rows]
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sizes.append((found := collect(self)).nbytes) or found)
    model, whole = quality.train(docs, labels), quality.fit(slots, np.array([k for _, _, k in rows]))
    assert (model.weights == whole.weights).all() and (model.thresholds == whole.thresholds).all() and (model.weights < 0).any()
    assert 0 < sum(sizes) < sum(s.nbytes for s in slots) / 10


def test_ties_of_telling_features_are_exact():
    for n, whole in ((997, 1700), (20_000, 35_001)):
        for rating in (0.0, 1.0, 2.0):  # rows of one rating lie exactly as many standard errors from the mean as the root of their number
            seen = np.arange(1.0, 200.0)
            assert (quality.tells(seen, seen * rating, seen * rating**2, n, whole, 1, 3.0) == (seen >= 9)).all()


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert Counter((r["doc_id"], r["text"], r["rating"]) for r in rows_of(quality.labelled(docs, labels))) == Counter([(1, "text 0", 1), (2, "", 2), (3, "c", 0)])
    assert quality.labelled(docs, labels, 1).count() == 1


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(None, 1, 0), (3, None, 0)], none.schema)
    for table in (none, labels):
        found = rows_of(quality.rate(docs, table))
        assert len(found) == docs.count() and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in found)
    assert all(r["kept"] for r in rows_of(quality.rate(docs, none)))
    assert quality.drop_rejected(docs, labels).columns == docs.columns
    assert quality.rate(empty(spark), labels).count() == 0


# --- markup -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>one<p>two <b>bold</b>\n x", "one\n\ntwo bold x"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=3><li>z<li value=9>y</ol>", "3. z\n9. y"),
        ("<table><tr><td>1<td>long cell<td>x<tr><td>wide one<td>r<td>y</table>", "1         long cell  x\nwide one  r          y"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>'</script>y", "xy"),
        ("a<div hidden>no</div><span style='color:red; DISPLAY : none'>no</span><i>b</i>", "ab"),
        ("<pre>\n a\n  b &lt;</pre>", " a\n  b <"),
        ("a<br>b<hr>c", "a\nb\n\nc"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<details><summary>s</summary>body</details>", "s"),
        ("text </div></p> after", "text\n\nafter"),
        ("&eacute; &amp;amp; &#x4e2d;", "é &amp; 中"),
        ("", ""),
        (None, ""),
        ("<", "<"),
    ],
)
def test_rendering(html, expected):
    assert html_text.render(html) == expected


def test_no_visible_text_is_lost():
    rng = random.Random(6)
    tags = "p div b i ul ol li table tr td th span h1 blockquote section dl dt dd em a".split()
    for _ in range(300):
        words, parts = [], []
        for k in range(rng.randint(1, 60)):
            parts.append(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f" w{k} "]))
            if parts[-1][0] == " ":
                words.append(parts[-1].strip())
        assert sorted(re.findall(r"w\d+", html_text.render("".join(parts)))) == sorted(words)


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + "out"
    assert html_text.render(deep).split() == ["in", "out"]
    assert html_text.render("<p>x" * 20_000).count("x") == 20_000


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<ol start=1990><li>a<li value=2024>b<li>c</ol>", "1990. a\n2024. b\n2025. c"),
        ("<ol start=99999999999><li>a</ol>", "1. a"),
        ("<div>" * 260 + "<script>var secret=1;</script><style>p{}</style><p hidden>HID</p>vis" + "</div>" * 260 + "out", "vis\nout"),
        ("<div>" * 300 + "<div hidden><div>HID<b>HID</b></div></div>vis", "vis"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>after", "yes\nafter"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
        ("<ul><li style='visibility:hidden'>a<br><li>b</ul>", "- b"),
        ("<p style='display:none; display:block'>x</p><p hidden style='display:block'>y</p><p style='display:none!important;display:block'>z</p>", "x\n\ny"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a     b\nc  d  e"),
    ],
)
def test_numbers_depth_and_visibility(html, expected):
    assert html_text.render(html) == expected


def test_layout_is_bounded_by_the_page():
    pages = [
        "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>",
        "<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 300 + "<tr><td>q" * 50 + "</table>",
        "<table>" + "<tr><td colspan=1000><td>x" * 1000 + "<tr>" + "<td>a" * 1001 + "</table>",
        "<blockquote>" * 250 + "a<br>" * 20_000,
        "<ul><li>" * 3000 + "x",
    ]
    for page in pages:
        assert len(html_text.render(page)) <= 10 * len(page)
        assert Counter(html_text.render(page).replace("-", "").split()) == Counter(re.sub(r"<[^>]*>", " ", page).split())


def test_random_pages_against_a_plain_model():
    """Blocks with inline content only: the model knows each block's lines and whether blank lines stand around it."""
    rng = random.Random(12)
    word = lambda: rng.choice("alpha beta gamma delta 12 é".split())

    def inline():
        html, text = [], []
        for _ in range(rng.randint(1, 6)):
            w, kind = word(), rng.randrange(5)
            html.append([f" {w}\n", f" <b>{w}</b> ", f" <i hidden>{w}</i>", f" <span style='display:none'>{w}<u>{w}</u></span> ", f" <em style='visibility:hidden'>{w} <u style='visibility:visible'>{w}</u></em> "][kind])
            text += [w] * (kind in (0, 1, 4))
        return "".join(html), " ".join(text)

    for _ in range(200):
        page, blocks = [], []
        for _ in range(rng.randint(1, 7)):
            kind = rng.choice(["p", "div", "ul", "ol", "table", "hidden"])
            cells = [[inline() for _ in range(2)] for _ in range(rng.randint(1, 4))]
            rows = [r[0] for r in cells]
            if kind in ("p", "div", "hidden"):
                page.append(f"<{kind.replace('hidden', 'section hidden')}>{rows[0][0]}</{kind.replace('hidden', 'section')}>")
                lines = [rows[0][1]] if kind != "hidden" else []
            elif kind in ("ul", "ol"):
                start = rng.choice([1, 7, 2000])
                page.append(f"<{kind} start={start}>" + "".join(f"<li>{h}" for h, _ in rows) + f"</{kind}>")
                lines = [f"{'-' if kind == 'ul' else f'{start + i}.'} {t}" for i, (_, t) in enumerate(rows) if t]
            else:
                page.append("<table>" + "".join("<tr>" + "".join(f"<td>{h}" for h, _ in r) for r in cells) + "</table>")
                texts = [[t for _, t in r] for r in cells]
                wide = max((len(a) for a, _ in texts if len(a) <= html_text.CELL), default=0)
                first = wide + 2 if any(a for a, _ in texts) else 0
                lines = [(((a + "  ") if a else "").ljust(first) + b if b else a) for a, b in texts if a or b]
            blocks.append((kind in ("p", "ul", "ol", "table"), [x for x in lines if x]))
        out, gap = [], False
        for spaced, lines in blocks:
            gap |= spaced
            if lines:
                out += [""] * (gap and bool(out)) + lines
                gap = spaced
        assert html_text.render("".join(page)).split("\n") == (out or [""]), "".join(page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "c"), (1, "u", "<p>a", "c"), (None, None, None, None), (2, "v", "", None)], "page_id long, url string, html string, text string")
    assert Counter(tuple(r.values()) for r in rows_of(html_text.extract(pages, keep=("url",)))) == Counter([(1, "u", "a", 1, 1)] * 2 + [(None, None, "", 0, 0), (2, "v", "", 0, 0)])
    clash = html_text.extract(pages, keep=("text", "url"))
    assert clash.columns == ["page_id", "page_text", "url", "text", "n_chars", "n_lines"]
    assert Counter((r["page_text"], r["text"]) for r in rows_of(clash)) == Counter([("c", "a")] * 2 + [(None, "")] * 2)
    assert html_text.extract(pages.limit(0)).count() == 0


# --- media ------------------------------------------------------------------------------------------------------------


def test_packed_integers_against_plain_sums():
    rng = np.random.default_rng(1)
    frames = rng.random((24, media.PITCHES))
    codes, sounds, turned = media.packed(frames)
    assert len(codes) == 24 - media.LONGEST + 1 and sounds.all()
    for t in (0, 5, 8):
        code = 0
        for kind, y, h, w in media.FILTERS:
            box, my, mt = frames[t : t + w], y + h // 2, w // 2
            a, b = {
                0: lambda: (box[:, y:my].mean(), box.mean()),
                1: lambda: (box[:, my : y + h].mean(), box[:, y:my].mean()),
                2: lambda: (box[:mt, y : y + h].mean(), box[mt:, y : y + h].mean()),
                3: lambda: (box[:mt, y:my].mean() + box[mt:, my : y + h].mean(), box[mt:, y:my].mean() + box[:mt, my : y + h].mean()),
            }[kind]()
            value = math.log((1 + a) / (1 + b))
            code = code << 2 | (0, 1, 3, 2)[(value >= -media.STEP) + (value >= 0) + (value >= media.STEP)]
        assert int(codes[t]) == code
    assert (np.bitwise_count(turned ^ codes) == 1).all() and all(len(set(column)) == media.WEAK for column in turned.T.tolist())


def test_recordings_align(spark):
    rng = np.random.default_rng(0)
    sound = lambda: media._chords()[rng.integers(0, 24, 130), rng.integers(0, 24, 130)].ravel().astype(float)
    base = [sound() for _ in range(6)]
    rows = [(i * 50 + 1, media.wav(x)) for i, x in enumerate(base)] + [(7, media.wav(base[0]))]
    rows += [(1000 + i * 50, media.wav(x[media.HOP * 20 : media.HOP * 90] * 0.4 + rng.normal(0, 80, media.HOP * 70))) for i, x in enumerate(base[:4])]
    rows += [(5000, media.wav(sound())), (5050, None), (5100, b"junk"), (5150, media.wav(np.zeros(20_000))), (None, media.wav(base[1][:100]))]
    found = {r["id"]: r for r in rows_of(media.match_recordings(spark.createDataFrame(rows, "id long, media binary"), ["id"], F.col("id") % 50 == 0))}
    assert len(found) == len(rows)
    for i in range(4):
        r = found[1000 + i * 50]
        assert (r["n_matches"], r["best_class"], r["offset"]) == (1, found[i * 50 + 1]["class_id"], 20) and r["bit_error"] < 0.1
    assert found[1]["class_size"] == 2 and found[7]["class_id"] == found[1]["class_id"]
    assert all(found[i]["n_matches"] == 0 and found[i]["best_class"] is None for i in (5000, 5050, 5100, 5150))
    assert all((found[i]["class_id"], found[i]["class_size"]) == (None, 1) for i in (5050, 5100, None))


def test_alignments_against_all_offsets(spark):
    """Noisy excerpts: every offset of every pair is tried, and all pairs that match so must be found at that offset."""
    rng = np.random.default_rng(3)
    sound = lambda n: media._chords()[rng.integers(0, 24, n), rng.integers(0, 24, n)].ravel().astype(float)
    base = [sound(80) for _ in range(12)]
    clips = list(base)
    for _ in range(40):
        x, at, n = base[rng.integers(12)], int(rng.integers(0, 40)), int(rng.integers(30, 40))
        clips.append(x[media.HOP * at : media.HOP * (at + n)] * rng.uniform(0.3, 1) + rng.normal(0, rng.uniform(0, 500), media.HOP * n))
    prints = [media.fingerprint(media.wav(c)) for c in clips]
    expected = {}
    for a, (x, _, _) in enumerate(prints):
        for b, (y, _, _) in enumerate(prints):
            if a != b:
                errors = []
                for off in range(-len(x) + 8, len(y) - 7):
                    p, q = x[max(0, -off) :], y[max(0, off) :]
                    n = min(len(p), len(q))
                    errors.append((np.bitwise_count((p[:n] ^ q[:n]).view(np.uint32)).sum() / (32 * n), off))
                if errors and min(errors)[0] <= 0.15:
                    expected[a, b] = min(errors)[1]
    rows = [(i, True, codes.tolist(), marks.tolist(), turned.tolist()) for i, (codes, marks, turned) in enumerate(prints)]
    found = {(r["id"], r["other"]): r for r in rows_of(media.alignments(spark.createDataFrame(rows, "id long, asks boolean, codes array<int>, marks array<int>, turned array<int>")))}
    right = [p for p, off in expected.items() if p in found and found[p]["offset"] == off]
    print("recall", len(right) / len(expected), len(expected))
    assert len(expected) > 100 and len(right) >= 0.9 * len(expected)
    for (a, b), r in found.items():
        x, y, off = prints[a][0], prints[b][0], r["offset"]
        p, q = x[max(0, -off) :], y[max(0, off) :]
        n = min(len(p), len(q))
        assert (r["overlap"], round(r["error"], 9)) == (n, round(np.bitwise_count((p[:n] ^ q[:n]).view(np.uint32)).sum() / (32 * n), 9))


def test_media_of_awkward_rows(spark):
    turns = spark.createDataFrame([(1, "two words", "x"), (1, "two words", "x"), (2, "two words", None), (3, None, "x"), (None, "", "x"), (4, "other", "x")], "votes long, text string, codes string")
    found = rows_of(media.match_recordings(media.voiced(turns, ["votes", "codes"]), ["votes", "codes"], F.col("votes") % 2 == 0))
    assert Counter((r["key_votes"], r["codes"], r["class_size"], r["n_matches"]) for r in found) == Counter([(1, "x", 3, None)] * 2 + [(2, None, 3, 0), (3, "x", 1, None), (None, "x", 1, None), (4, "x", 1, 0)])
    assert media.match_recordings(media.voiced(turns.limit(0), ["votes"]), ["votes"], F.lit(True)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    tokens = corpus_pipeline.run(spark, DATA)
    assert tokens.count() == seen[4] and tokens.filter("n_tokens = 0").count() == 0


def test_pipeline_stages_on_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents(spark), empty(spark)):
            out = stage(spark, docs, DATA)
            assert out.count() <= 2 * docs.count(), name
