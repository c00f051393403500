"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(rating <= j) = sigmoid(threshold_j - weights . features), with one set of weights for all grades and ordered thresholds.
Features are hashed: words without their outer punctuation, their first letters, shapes of tokens, and how often tokens repeat. The model is
fitted on the driver, on at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id; it scores all rows where they are read. Features
that get no weight are found by counts in Spark and don't come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import Workspace

#: Labelled rows to fit on, at most; all rows are scored.
SAMPLE = 20_000
DIM, LEAST_ROWS, LEAST_Z, STEPS, RATE, RIDGE = 1 << 20, 4, 3.0, 150, 0.2, 1e-6
GRADES = 3
PREFIXES = (4, 5, 6)
#: Rows that the fit adds up at once.
BLOCK = 1000
#: Tokens whose slots a worker remembers.
MEMO = 100_000
_EDGES = re.compile(r"^\W+|\W+$")
_RUNS = re.compile(r"(.)\1+")


def _shape(token: str) -> str:
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token[:40])
    return _RUNS.sub(r"\1", kinds)


def _slot(kind: str, value: str) -> int:
    return crc32(f"{kind}{value}".encode()) % DIM


def _slots(token: str) -> tuple[int, ...]:
    word = _EDGES.sub("", token).lower()
    return (_slot("w", word), _slot("s", _shape(token)), *(_slot("p", word[:n]) for n in PREFIXES if len(word) > n))


class Features:
    """Sorted distinct feature slots of a text; the slots of a token are remembered."""

    def __init__(self, most: int = MEMO):
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        distinct = set(tokens)
        if len(self.memo) + len(distinct) > self.most:
            self.memo.clear()
        slots: set[int] = set()
        for token in distinct:
            if (own := self.memo.get(token)) is None:
                own = self.memo[token] = _slots(token)
            slots.update(own)
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        slots.add(_slot("r", str(int(10 * again / len(tokens)) if tokens else -1)))
        slots.add(_slot("v", str(int(10 * len(distinct) / len(tokens)) if len(tokens) > 50 else -1)))
        slots.add(_slot("n", str(len(tokens).bit_length())))
        return np.array(sorted(slots), np.int32)


@dataclass
class Ordinal:
    """Weights and ordered thresholds; ``score`` is weights . features."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """[row, j]: the probability of a rating of at least j + 1."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tails(score).sum(axis=1)


def tells[T: (Column, np.ndarray)](seen: T, total: T, squares: T, n: int, whole: int, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z) -> T:
    """Whether features may get a weight, from their number of rows and the sums of these rows' ratings and of the squares, as doubles;
    all ``n`` ratings add up to ``whole``. The sums are of integers, so that neither their order nor rounding decides ties."""
    pull = total * n - seen * whole  # n times the sum of deviations from the mean
    spread = squares * n**2 - total * (2 * n * whole) + seen * whole**2  # n * n times the sum of their squares
    return (seen >= least_rows) & (pull * pull >= spread * least_z**2) & (pull * pull >= int(least_z > 0))


def fit(rows: list[np.ndarray], ratings: np.ndarray, grades: int = GRADES, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z, most_weight: float = 0.0) -> Ordinal:
    """``descend`` without the features in under ``least_rows`` rows and those whose rows' ratings together lie less than
    ``least_z`` standard errors from the mean, which get no weight: neutral words must not add up in long texts."""
    seen, total, squares = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(rows), 500):
        part = rows[at : at + 500]
        slots = np.concatenate(part)
        own = np.repeat(ratings[at : at + 500], [len(r) for r in part])
        seen += np.bincount(slots, minlength=DIM)
        total += np.bincount(slots, own, DIM)
        squares += np.bincount(slots, own**2, DIM)
    kept = tells(seen, total, squares, len(rows), int(ratings.sum()), least_rows, least_z)
    return descend([r[kept[r]] for r in rows], ratings, grades, most_weight)


def descend(kept: list[np.ndarray], ratings: np.ndarray, grades: int = GRADES, most_weight: float = 0.0) -> Ordinal:
    """Adam steps on the mean log loss with a ridge, over the features of each row. No weight is above ``most_weight``: at zero,
    features can only lower a grade, so good words don't make up for a bad one; at infinity the regression is unrestricted.

    Without rows the thresholds are minus infinity: everything passes.
    """
    if not kept:
        return Ordinal(np.zeros(DIM, np.float32), np.full(grades - 1, -np.inf))
    used = np.zeros(DIM, bool)
    for row in kept:
        used[row] = True
    place, k, blocks = np.cumsum(used, dtype=np.int32) - np.int32(1), int(used.sum()), []
    for at in range(0, len(kept), BLOCK):  # a block at a time, so that no long array of doubles is made in a step
        part = kept[at : at + BLOCK]
        blocks.append((slice(at, at + len(part)), np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part]), place[np.concatenate(part)]))
    n, beyond = len(kept), ratings[:, None] > np.arange(grades - 1)
    share = np.clip(beyond.mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.minimum.accumulate(share)
    first = -np.log(start / (1 - start))
    # thresholds: the first, then the logarithms of the gaps, so they stay ordered
    theta = np.concatenate([np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gaps = np.exp(theta[k + 1 :])
        cuts = theta[k] + np.r_[0, np.cumsum(gaps)]
        score = np.concatenate([np.bincount(owner, theta[:k][column], rows.stop - rows.start) for rows, owner, column in blocks])
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -500, 500)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        high, low = edges[np.arange(n), ratings], edges[np.arange(n), ratings + 1]
        p = np.maximum(high - low, 1e-12)
        slope = above * (1 - above)
        rise = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
        up, down = rise[np.arange(n), ratings] / p, rise[np.arange(n), ratings + 1] / p
        by_score = (down - up) / n
        by_cut = np.array([((ratings == j + 1) * up - (ratings == j) * down).sum() / n for j in range(grades - 1)])
        by_weight = sum(np.bincount(column, by_score[rows][owner], k) for rows, owner, column in blocks)
        grad = np.concatenate([by_weight + RIDGE * theta[:k], [by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.minimum(theta[:k], most_weight, out=theta[:k])
    weights = np.zeros(DIM, np.float32)
    weights[used] = theta[:k]
    return Ordinal(weights, theta[k] + np.r_[0, np.cumsum(np.exp(theta[k + 1 :]))])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, rating of at most ``sample`` labelled documents: 0 toxic, 1 poor, 2 good.

    Labels with a null are left out; of several labels of one document the least rating counts, and of several rows of
    ``docs`` with one doc_id the first text in order, so that no more than ``sample`` rows come out.
    """
    rating = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, GRADES - 1).otherwise(1).alias("rating")
    rows = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", rating)
    rows = rows.groupBy("doc_id").agg(F.min("rating").alias("rating"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("rating").alias("rating"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """``fit`` on the bounded sample. Which features tell is found by counts in Spark; of each row only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            slots = pa.array([features.of(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), slots, batch.column(2)], ["doc_id", "slots", "rating"])

    work = Workspace(docs.sparkSession, "quality")
    rows = labelled(docs, labels, sample).select("doc_id", "text", "rating")
    rows = work.save("slots", rows.mapInArrow(run, "doc_id long, slots array<int>, rating int"))
    n, whole = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("rating"), F.lit(0))).first()
    sums = [F.count(F.lit(1)), F.sum("rating"), F.sum(F.col("rating") * F.col("rating"))]
    counts = rows.select(F.explode("slots").alias("slot"), "rating").groupBy("slot").agg(*[x.cast("double").alias(c) for x, c in zip(sums, "abc")])
    telling = np.sort(counts.filter(tells(F.col("a"), F.col("b"), F.col("c"), n, whole)).select("slot").toArrow()["slot"].to_numpy())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(s.values.to_numpy(), telling, assume_unique=True).tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), batch.column(2)], ["doc_id", "slots", "rating"])

    found = rows.mapInArrow(keep, "doc_id long, slots binary, rating int").toArrow().sort_by("doc_id")
    work.close()
    return descend([np.frombuffer(s.as_buffer(), np.int32) for s in found["slots"]], found["rating"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus _expected (grade), _tail (probability of the highest grade) and _kept (_tail >= ``least``).

    Null text counts as empty; a text without words has only the features of its length.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), Ordinal(weights, thresholds)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            scores = np.array([weights[features.of(t.as_py())].sum(dtype=np.float64) for t in texts])
            tails = own.tails(scores)[:, -1] if len(scores) else np.empty(0)
            more = [pa.array(own.expected(scores) if len(scores) else tails), pa.array(tails), pa.array(tails >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_chronolex_expected", "_chronolex_tail", "_chronolex_kept"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, _chronolex_expected double, _chronolex_tail double, _chronolex_kept boolean")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, expected_grade (0 to 2), tail_probability, kept. Reads doc_id and text.

    Null texts count as empty, null doc_ids and repeated rows are rated like others; without labels all are kept.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.col("_chronolex_expected").alias("expected_grade"), F.col("_chronolex_tail").alias("tail_probability"), F.col("_chronolex_kept").alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return score(docs, train(docs, labels)).filter("_chronolex_kept").select(*docs.columns)
