"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronolex.llm import exact_dedup, fingerprint_log, near_copies, repeats, simhash, suffixes
from chronolex.llm.common import Workspace
from chronolex.llm.components import connected_components

from tests.llm.cases import documents, empty, order, rows_of

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


# --- exact ------------------------------------------------------------------------------------------------------------


def test_misra_gries_keeps_every_heavy_key():
    rng = random.Random(2)
    keys = [rng.choice("abc") if rng.random() < 0.5 else f"k{rng.randint(0, 5000)}" for _ in range(20_000)]
    found = exact_dedup.misra_gries((keys[i : i + 700] for i in range(0, len(keys), 700)), 20)
    assert len(found) <= 20
    counts = Counter(keys)
    assert {k for k, n in counts.items() if n > len(keys) / 21} <= set(found)
    assert all(found[k] <= counts[k] for k in found)


@pytest.mark.parametrize("counters", [1, 1000])
def test_exact_groups(spark, counters):
    docs = documents(spark)
    found = rows_of(exact_dedup.duplicate_groups(docs, counters))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows_of(docs):
        groups[sha256(norm(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    assert len(found) == docs.count()
    for r in found:
        ids = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(ids, key=order), len(ids))
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


def test_exact_stage_keeps_one_row_with_all_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows_of(kept)]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows_of(docs)})


@pytest.mark.parametrize("counters", [1, 1000])
def test_exact_stage_against_brute_force(spark, counters):
    docs = documents(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best = {}
    for r in rows_of(docs):
        best[norm(r["text"])] = min(best.get(norm(r["text"]), float("inf")), order(r["doc_id"]))
    kept = rows_of(exact_dedup.drop_copies(docs, counters))
    assert Counter((norm(r["text"]), order(r["doc_id"])) for r in kept) == Counter(best.items())
    rows = [(None, "a"), (None, "b"), (None, "a"), (5, "c"), (5, "d"), (5, "c"), (7, "a")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counters)
    assert Counter(map(tuple, kept.collect())) == Counter([(7, "a"), (None, "b"), (5, "c"), (5, "d")])
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


# --- near -------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    docs = documents(spark)
    rows = rows_of(docs)
    prints = [slow_fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
    least = {g: min((r["doc_id"] for r, x in zip(rows, label, strict=True) if x == g), key=order) for g in set(label)}
    expected = Counter((r["doc_id"], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, label, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.near_groups(docs))) == expected
    assert simhash.near_groups(empty(spark)).count() == 0


def test_links_are_exactly_the_close_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    turned = [int(b) ^ int(np.bitwise_or.reduce([np.int64(1) << np.int64(k) for k in rng.choice(64, n, replace=False)])) for b in base for n in (1, 2, 3, 4, 5)]
    prints = sorted({*map(int, base), *turned})
    expected = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert found == expected and len(expected) > 120


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1050)] + [(5000, 4000), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000), 5000: 4000, 4000: 4000}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    docs = documents(spark)
    groups = {(r["component_id"]) for r in rows_of(simhash.near_groups(docs))}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def similar_cases(spark):
    """Texts of 80 words with one to four words changed, on both sides of a similarity of 0.8, and a chain."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = make(80)
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4):
            w = list(base)
            for at in rng.sample(range(80), changes):
                w[at] = f"z{rng.randint(0, 900)}"
            texts.append(" ".join(w))
    chain = make(120)
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 30, 3)]
    docs = documents(spark)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    return docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)


def slow_similar(texts, size, least):
    """Component label of each text."""
    def runs(t):
        w = [x.lower() for x in words(t)]
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    s = [runs(t) for t in texts]
    near = [[j for j, y in enumerate(s) if len(x & y) / len(x | y) >= least] for x in s]
    label = list(range(len(s)))
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    return label


@pytest.mark.parametrize(("size", "least"), [(5, 0.8), (3, 0.6)])
def test_similar_stage_keeps_one_of_each_group(spark, size, least):
    docs = similar_cases(spark)
    rows = rows_of(docs)
    label = slow_similar([r["text"] for r in rows], size, least)
    expected = Counter(min((r["doc_id"] for r, x in zip(rows, label, strict=True) if x == g), key=order) for g in set(label))
    kept = near_copies.drop_similar(docs, size, least)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in rows_of(kept)) == expected
    assert near_copies.drop_similar(empty(spark)).count() == 0


@pytest.mark.parametrize("drop", [simhash.drop_near_copies, near_copies.drop_similar])
def test_near_stages_keep_rows_without_or_with_clashing_ids(spark, drop):
    rng = random.Random(6)
    make = lambda: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(50))
    lone, copied, twice = [make() for _ in range(4)], make(), [make(), make()]
    rows = [(None, t) for t in lone] + [(None, lone[0]), (None, copied), (3, copied), (9, copied)] + [(5, t) for t in twice] + [(5, twice[0])]
    kept = Counter((r["doc_id"], r["text"]) for r in rows_of(drop(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))))
    assert kept == Counter([(None, t) for t in lone] + [(3, copied)] + [(5, t) for t in twice])


def slow_chains(text, size, length):
    """SimHashes of the shingles that follow each other in the order of their hashes, from each start."""
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = sorted({xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))})
    chains = [[h[(i + j) % len(h)] for j in range(min(length, len(h)))] for i in range(len(h))]
    return {sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in c) > len(c)) for c in chains}


def test_similar_stage_takes_simhashes_of_chains_as_keys(spark):
    rows = rows_of(similar_cases(spark).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))))
    text = {bytes(r["digest"]): r["text"] for r in rows}
    for r in near_copies.sketches(similar_cases(spark)).collect():
        keys, slow = {k & (1 << 64) - 1 for k in r["keys"]}, slow_chains(text[bytes(r["digest"])], 5, 4)
        assert len(keys) == len(r["keys"]) and (keys == slow if r["n"] < 128 else keys < slow and len(keys) > 30)


@pytest.mark.parametrize(("common", "apart"), [(4, 1), (8, 2), (12, 3), (40, 10), (100, 25)])
def test_similar_sets_share_a_chain_wherever_they_differ(common, apart):
    """At a similarity of 0.8, also where what differs is as evenly spread over the ring as can be, and all in one text."""
    rng = np.random.default_rng(8)
    for spread in [True, *[False] * 40]:
        h = np.sort(rng.integers(0, 1 << 64, common + apart, dtype=np.uint64))
        other = np.arange(common + apart) % 5 == 4 if spread else rng.permutation(common + apart) < apart
        for own in (np.zeros(common + apart, bool), rng.random(common + apart) < 0.5):
            a, b = h[~other | own], h[~(other & own)]
            assert set(near_copies.chain_keys(a, near_copies.chain_length(0.8))) & set(near_copies.chain_keys(b, near_copies.chain_length(0.8)))


def test_ring_holds_simhashes_of_segments():
    h = np.random.default_rng(3).integers(0, 1 << 64, 1500, dtype=np.uint64)
    planes = np.unpackbits(near_copies.ring(h).view(np.uint8), bitorder="little").reshape(near_copies.PLANES, near_copies.BINS)
    for segment in range(near_copies.BINS):
        own = [int(x) for x in h if int(x) >> 55 == segment]
        assert planes[:, segment].tolist() == [2 * sum(x >> b & 1 for x in own) > len(own) for b in range(near_copies.PLANES)]


def test_pipeline_drops_similar_texts(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(120)]
    other = base[:60] + ["new"] + base[61:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert (slow_fingerprint(" ".join(base)) ^ slow_fingerprint(" ".join(other))).bit_count() > 3
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()] == [1]


# --- passages ---------------------------------------------------------------------------------------------------------


def slow_removal(rows, units, window, within):
    """What stays of each row by the rule, window by window; rows with one doc_id are one document."""
    first = {}
    for r in sorted(rows, key=lambda r: order(r["doc_id"])):
        u = units(r["text"])
        for i in range(len(u) - window + 1):
            here = (order(r["doc_id"]), i)
            key = tuple(u[i : i + window])
            first[key] = min(first.get(key, here), here)
    out = Counter()
    for r in rows:
        u, gone = units(r["text"]), set()
        for i in range(len(u) - window + 1):
            f = first[tuple(u[i : i + window])]
            if f < (order(r["doc_id"]), i) if within else f[0] < order(r["doc_id"]):
                gone.update(range(i, i + window))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(u)))
        kept = [x for i, x in enumerate(u) if i not in gone]
        kept = bytes(kept) if not within else " ".join(kept).encode()
        out[r["doc_id"], len(u), len(gone), spans, sha256(kept).hexdigest()] += 1
    return out


def passages(spark):
    """Overlapping, repeated and periodic passages; windows of which only a part repeats."""
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    a, b, c = make(70), make(45), make(21)
    texts = [a, f"{make(5)} {a[:260]} {make(9)}", f"{b} {make(3)} {b}", f"{a} {b} {c}", "x " * 90, f"{c} {make(30)} {c}", make(400), " ".join(make(400).split()[:300]), c, make(19), None, "", "y" * 130, "y" * 55]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, a + " " + b), (100, texts[0]), (None, b), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_classes_are_compared_by_window(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = passages(spark)
    rows = rows_of(docs)
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffixes.remove_repeats(docs)))
    assert found == slow_removal(rows, lambda t: (t or "").encode(), 50, False)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(fingerprint_log.remove_repeats(docs, 2)) if r["doc_id"] != 100)
    assert found == Counter({k: n for k, n in slow_removal(rows, words, 20, True).items() if k[0] != 100})


@pytest.mark.parametrize("source", [passages, documents])
def test_byte_passages(spark, source):
    docs = source(spark)
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffixes.remove_repeats(docs)))
    assert found == slow_removal(rows_of(docs), lambda t: (t or "").encode(), 50, False)


@pytest.mark.parametrize("batches", [1, 4])
@pytest.mark.parametrize("source", [passages, documents])
def test_word_passages(spark, source, batches):
    docs = source(spark)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(fingerprint_log.remove_repeats(docs, batches)))
    rows = rows_of(docs)
    ambiguous = {k for k, n in Counter(r["doc_id"] for r in rows).items() if n > 1}  # rows of one doc_id are one document
    keep = lambda c: Counter({k: n for k, n in c.items() if k[0] not in ambiguous})
    assert keep(found) == keep(slow_removal(rows, words, 20, True))


def test_passages_of_an_empty_table(spark):
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    assert fingerprint_log.remove_repeats(empty(spark)).count() == 0


def test_suffix_order_matches_sorting():
    rng = np.random.default_rng(4)
    text = np.frombuffer(b"".join([b"ab" * 90, bytes(rng.choice([97, 98], 300).tolist()), b"ab" * 70, b"a" * 200]), np.uint8)
    at = np.arange(0, len(text) - 60)
    order_, same = suffixes.sort_suffixes(text, at, 50)
    raw = text.tobytes()
    heads = [raw[i : i + 50] for i in order_]
    assert heads == sorted(heads) and sorted(order_.tolist()) == at.tolist()
    assert same.tolist() == [False] + [a == b for a, b in zip(heads, heads[1:], strict=False)]


def test_difference_cover_meets_every_pair():
    assert all(suffixes.IN_COVER[(a + suffixes.DISTANCE[a, b]) % 31] and suffixes.IN_COVER[(b + suffixes.DISTANCE[a, b]) % 31] for a in range(31) for b in range(31))


@pytest.mark.parametrize("most", [1, 2, 9])
def test_log_is_kept_between_calls(spark, tmp_path, most):
    """Adding in order, a call and a session's object at a time, says what one call says; compaction changes nothing."""
    docs = passages(spark).union(documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    digest = lambda frame: Counter((r["doc_id"], r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(frame))
    expected = digest(fingerprint_log.remove_repeats(docs, 1))
    found, cuts = Counter(), [0, 13, 102, 1010, 1 << 40]
    for low, high in zip(cuts, cuts[1:], strict=False):
        log = fingerprint_log.FingerprintLog.open(spark, str(tmp_path / "index"), most=most)
        inside = (F.col("doc_id") >= low) & (F.col("doc_id") < high)
        found += digest(log.add(docs.filter(inside if high < 1 << 40 else inside | F.col("doc_id").isNull())))
        assert len(log.state["runs"]) <= max(most, 1)
    assert found == expected
    log = fingerprint_log.FingerprintLog.open(spark, str(tmp_path / "index"), most=most)
    log.compact()
    assert len(log.state["runs"]) == 1 and log.state["batches"] == 4
    again = docs.filter("doc_id = 0").select((F.col("doc_id") + (1 << 41)).alias("doc_id"), "text")
    assert [(r["n_words"], r["n_removed"]) for r in rows_of(log.add(again))] == [(70, 70)]


def test_merged_runs_are_sorted_and_distinct():
    rng = np.random.default_rng(1)
    values, docs = rng.integers(0, 50, 200).astype(np.uint64), rng.integers(1, 9, 200)
    merged, owner = fingerprint_log.merge_runs(values, docs)
    assert merged.tolist() == sorted(set(values.tolist()))
    for v, d in zip(merged.tolist(), owner.tolist(), strict=True):
        own = docs[values == v]
        assert d == (own[0] if len(own) == 1 else 0)
