"""Byte dedup by blockwise suffix sorting with a difference cover.

Every byte position that starts a window of 50 bytes whose class more than one document has is a suffix to be sorted.
Suffixes are dealt to buckets by their class; a bucket is sorted at a time, so memory is bounded by the bucket. A bucket's
suffixes are sorted by their first 31 bytes. What still ties is resolved by the ranks of a sample: the positions whose
residue modulo 31 lies in a difference cover, so any two suffixes have a distance below 31 at which both meet the sample.
Neighbours in the sorted order that share 50 bytes are occurrences of one string, and the smallest document keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolex.llm.common import Workspace, text_or_empty
from chronolex.llm.repeats import BUCKET, HIT, ROWS, Repeats, Unit, as_rows, keyed, repeated, unpack_all

BYTES = Unit(window=50, gram=24, words=False, within=False)
PERIOD = 31
# A perfect difference set modulo 31; each non-zero residue is the difference of one pair.
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes to which sample ranks are exact; with the least distance of 0 that is no less than a window.
DEPTH = 56


def _distances() -> np.ndarray:
    """[a, b]: the least d with a + d and b + d in the cover, modulo the period."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


DISTANCE = _distances()
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number; zeros follow the text."""
    w = np.concatenate([text, np.zeros(2 * DEPTH + PERIOD, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        after = np.zeros_like(w)
        after[:-shift] = w[shift:]
        w = (w << np.uint64(8 * shift)) | after
    return w


class Order:
    """Suffixes in an order that is refined step by step; ``fresh`` marks where a group of ties begins."""

    def __init__(self, suffixes: np.ndarray):
        self.at, self.fresh = suffixes, np.zeros(len(suffixes), bool)
        if len(suffixes):
            self.fresh[0] = True

    def groups(self) -> np.ndarray:
        return np.cumsum(self.fresh) - 1

    def tied(self) -> np.ndarray:
        """Places in the order whose group has more than one suffix."""
        ends = np.r_[self.fresh[1:], True]
        return np.flatnonzero(~(self.fresh & ends))

    def refine(self, places: np.ndarray, keys: np.ndarray) -> None:
        """Sort each group within ``places`` (whole groups) by the keys of their suffixes and split it where keys change."""
        group = self.groups()[places]
        order = np.lexsort((keys, group))
        keys = keys[order]
        self.at[places] = self.at[places[order]]
        self.fresh[places[1:]] |= keys[1:] != keys[:-1]


def by_prefix(words: np.ndarray, suffixes: np.ndarray, offsets: tuple[int, ...]) -> Order:
    order = Order(suffixes.copy())
    for offset in offsets:
        if len(places := order.tied()):
            order.refine(places, words[order.at[places] + offset])
    return order


def cover_ranks(words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """At each sample position that a tie of ``suffixes`` can ask for, its rank by the next DEPTH bytes; equal text, equal rank."""
    n = len(words) + PERIOD + 1
    near = np.bincount(suffixes, minlength=n) - np.bincount(suffixes + PERIOD, minlength=n)
    positions = np.flatnonzero(np.cumsum(near)[: len(words)] > 0)
    positions = positions[IN_COVER[positions % PERIOD]]
    order = by_prefix(words, positions, tuple(range(0, DEPTH, 8)))
    ranks = np.zeros(len(words), np.int32)
    ranks[order.at] = order.groups()
    return ranks


def sort_suffixes(text: np.ndarray, suffixes: np.ndarray, window: int = BYTES.window) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in lexicographic order (exact to a window), and whether each shares its first ``window`` bytes with the one before."""
    words = words_at(text)
    order = by_prefix(words, suffixes, (0, 8, 16, PERIOD - 8))
    shallow = order.fresh.copy()
    places = order.tied()
    if len(places):
        ranks = cover_ranks(words, order.at[places])
    while len(places):
        group = order.groups()[places]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(places)])
        pivot = np.repeat(order.at[places[starts + sizes // 2]], sizes)
        own = order.at[places]
        d = DISTANCE[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[own + d] - ranks[pivot + d])
        equal = own[side == 0]
        order.refine(places, side)
        settled = np.zeros(len(words), bool)
        settled[equal] = True
        places = places[~settled[order.at[places]]]
        tied = np.zeros(len(order.at), bool)
        tied[order.tied()] = True
        places = places[tied[places]]
    a, b = order.at[1:], order.at[:-1]
    same = np.zeros(len(order.at), bool)
    close = np.flatnonzero(~shallow[1:])
    a, b = a[close], b[close]
    alike = np.ones(len(close), bool)
    for offset in (PERIOD, PERIOD + 8, window - 8):
        alike &= words[a + offset] == words[b + offset]
    same[1:][close[alike]] = True
    return order.at, same


def first_documents(table: pa.Table, window: int = BYTES.window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each segment of a bucket, and the smallest document of each window; starts do not count."""
    pieces = table["seg"].to_pylist()
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes) - sizes
    n = sizes - window + 1
    owner = np.repeat(np.arange(len(pieces)), n)
    suffixes = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
    order, same = sort_suffixes(np.frombuffer(b"".join(pieces), np.uint8), suffixes, window)
    at = np.zeros(int(sizes.sum()) + 1, np.int64)
    at[suffixes] = np.arange(len(suffixes))
    back = at[order]
    ords = table["ord"].to_numpy()[owner]
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(ords[back], heads) if len(heads) else ords
    first = np.empty_like(ords)
    first[back] = np.repeat(least, np.diff(np.r_[heads, len(back)]))
    return n, first, first


def repeated_classes(blobs: DataFrame, n_groups: int) -> DataFrame:
    """Hits (kind, key, blob): the documents of each class that more than one document has."""

    def run(table: pa.Table) -> pa.Table:
        values, docs, twice = repeated(*unpack_all(table["blob"]))
        twice &= docs != 0
        return pa.Table.from_batches([as_rows(keyed(HIT, docs[twice] % n_groups, values[twice], docs[twice]))])

    return blobs.filter(f"kind = {BUCKET}").groupBy("key").applyInArrow(run, ROWS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Null text counts as
    empty. Rows with one doc_id are one document; a null doc_id comes after all others. Texts of under 50 bytes stay
    whole. Only doc_id and text are read; an empty table gives an empty result.
    """
    task = Repeats(docs, BYTES, text_or_empty(), Workspace(docs.sparkSession, "suffixes"))
    blobs = task.work.save("blobs", task.blobs())
    hits = task.work.save("hits", repeated_classes(blobs, task.groups).union(blobs.filter(f"kind = {HIT}")))
    segments = task.work.save("segments", task.segments(hits))
    for name in ("blobs", "hits"):
        task.work.drop(name)
    firsts = task.work.save("firsts", task.firsts(segments, first_documents))
    out = task.outcome(segments, firsts).withColumnRenamed("size", "n_bytes")
    task.work.only("rows", "per_text")
    return out
