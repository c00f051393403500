"""Small documents with every awkward case, and helpers."""

from __future__ import annotations

import random

WORDS = "the of and net graph model data token shard média größe año 数据 x1 it's".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string, digest string, kept string, row string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, seed: int = 1):
    """Nulls in any column, empty and very long texts, copies, near copies, shared passages, repeated rows, clashing columns."""
    rng = random.Random(seed)
    passage, long = sentence(rng, 60), sentence(rng, 30_000)
    texts = [sentence(rng, rng.randint(1, 150)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1].replace(" ", "  \t"), texts[2] + " tail", f"{texts[3]} {passage} {texts[4]}", f"{passage} {texts[5]}", passage, long, long[:4000]]
    texts += ["", None, " \n\t ", None, "", "spam " * 200, "one", "one", "a b", "word"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", "s2", None]), None if t is None else len(t), "q", None, "d", None, "r") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[8], "en", "s0", 1, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:]), (None, texts[8], "en", "s0", 1, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def order(doc_id) -> float:
    return float("inf") if doc_id is None else doc_id
