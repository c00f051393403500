"""What the two operators on repeated passages share: window classes, segments and their way between documents and buckets.

A window is ``window`` consecutive units (bytes or words) of one document. Its class is the smallest hash of the shorter
grams in it, so equal windows have equal classes and a run of consecutive windows mostly shares one. Only classes that
more than one document has (or one document repeats) can hold repeated windows; runs of such windows travel as segments,
pieces of text of a few dozen units, and meet in a bucket of their class, where windows are compared by their text.

The steps: equal documents are one (their first doc_id counts) with a number of their own, ``Repeats.blobs`` lists classes, a caller finds the
repeated ones, ``segments`` fetches their text, the caller's verifier finds where each window first starts, and
``outcome`` applies that to the documents. Equal segments are pre-aggregated wherever they meet, so a passage in a third
of all documents is one row a task. Nothing is gathered on the driver but row counts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from chronolex.llm.common import Workspace

U = np.uint64
BASE, FOLD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Units in one piece of work on a very long document.
LONG = 1 << 20
LAST = (1 << 63) - 1
#: Segments of one class above which its windows are compared one by one, spread over all tasks.
HOT = 50_000
FIRSTS = "cls long, sid long, least long, firsts binary"
#: Numbers of one pass's documents: those of monotonically_increasing_id with up to 2 ** 19 partitions.
PASS = 1 << 52
BUCKET_BYTES, GROUP_BYTES, LEAST_BUCKETS, LEAST_GROUPS = 24 << 20, 8 << 20, 64, 512


@lru_cache(maxsize=64)
def _power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


@lru_cache(maxsize=8)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    steps = np.full(n, U(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


@lru_cache(maxsize=1)
def _byte_hashes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(FOLD)
    return (h ^ (h >> U(32))) * U(FOLD)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k units, put together from runs of powers of two."""
    out, done, size = None, 0, 1
    while True:
        if k & 1:
            if out is None:
                out = h
            else:
                m = len(h) - done
                out = out[:m] * _power(size) + h[done:]
            done += size
        k >>= 1
        if not k:
            return out
        h = h[:-size] * _power(size) + h[size:]
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - (w - size)], h[w - size :])


@dataclass
class Runs:
    """Runs of windows of equal class: class, first and last window; and where units begin and end in the text."""

    cls: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begins: np.ndarray | None
    ends: np.ndarray | None
    own: np.ndarray

    def piece(self, text: bytes, i: int, window: int) -> bytes:
        a, b = self.first[i], self.last[i] + window
        return text[a:b] if self.begins is None else text[self.begins[a] : self.ends[b - 1]]


@dataclass(frozen=True)
class Unit:
    """window and gram in units; words: units are the words of a text with single spaces, else bytes.

    within: windows that start earlier in the same document count too.
    """

    window: int
    gram: int
    words: bool
    within: bool

    def bounds(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
        if not self.words:
            return None, None
        space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        if not text:
            return space, space
        begins, ends = np.empty(len(space) + 1, np.int64), np.empty(len(space) + 1, np.int64)
        begins[0], begins[1:], ends[:-1], ends[-1] = 0, space + 1, space, len(text)
        return begins, ends

    def windows(self, text: bytes) -> list[bytes]:
        if not self.words:
            return [text[i : i + self.window] for i in range(len(text) - self.window + 1)]
        words = text.split(b" ")
        return [b" ".join(words[i : i + self.window]) for i in range(len(words) - self.window + 1)]

    def count(self, text: bytes) -> int:
        return len(text) if not self.words else text.count(b" ") + bool(text)

    def _hashes(self, text: bytes, begins, ends, a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        if not self.words:
            return _byte_hashes()[raw[a:b]]
        low = begins[a]
        raw = raw[low : ends[b - 1]]
        size = 1 << max(16, int(len(raw)).bit_length())
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_byte_hashes()[raw] * _powers(size, False)[: len(raw)], out=sums[1:])
        start = begins[a:b] - low
        return fold((sums[ends[a:b] - low] - sums[start]) * _powers(size, True)[start])

    def runs(self, text: bytes) -> Runs | None:
        """None for a text without a window. ``own``: classes of windows that the text repeats itself."""
        begins, ends = self.bounds(text)
        n = (len(text) if begins is None else len(begins)) - self.window + 1
        if n < 1:
            return None
        cls, first, last, whole = [], [], [], []
        for a in range(0, n, LONG):
            b = min(n, a + LONG)
            h = self._hashes(text, begins, ends, a, b + self.window - 1)
            c = sliding_min(gram_hashes(h, self.gram), self.window - self.gram + 1)
            cut = np.flatnonzero(c[1:] != c[:-1])
            start, end = np.empty(len(cut) + 1, np.int64), np.empty(len(cut) + 1, np.int64)
            start[0], start[1:], end[:-1], end[-1] = a, cut + (a + 1), cut + a, len(c) - 1 + a
            cls.append(fold(c[start - a]) >> U(16))
            first.append(start)
            last.append(end)
            if self.within:
                whole.append(np.stack([gram_hashes(h, self.window), c]))
        own = np.empty(0, np.uint64)
        if self.within:
            h, c = np.concatenate(whole, axis=1)
            order = np.argsort(h)
            twin = h[order][1:] == h[order][:-1]
            own = np.unique(fold(c[order[1:][twin]]) >> U(16))
        if len(cls) == 1:
            return Runs(cls[0], first[0], last[0], begins, ends, own)
        return Runs(*map(np.concatenate, (cls, first, last)), begins, ends, own)


def pack(values: np.ndarray, docs: np.ndarray) -> bytes:
    """Classes (48 bits each) and the documents that have them, 0 for no single one."""
    table, at = np.unique(docs, return_inverse=True)
    small = np.uint16 if len(table) < 1 << 16 else np.uint32
    low = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([np.array([len(table), len(values)], np.uint32).tobytes(), table.tobytes(), at.astype(small).tobytes(), low.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_docs, n = np.frombuffer(blob, np.uint32, 2)
    table = np.frombuffer(blob, np.int64, n_docs, 8)
    small = np.uint16 if n_docs < 1 << 16 else np.uint32
    at = np.frombuffer(blob, small, n, 8 + 8 * int(n_docs))
    values = np.zeros((n, 8), np.uint8)
    values[:, :6] = np.frombuffer(blob, np.uint8, 6 * int(n), 8 + 8 * int(n_docs) + at.nbytes).reshape(-1, 6)
    return values.view(np.uint64).ravel(), table[at]


def unpack_all(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    both = [unpack(b.as_buffer()) for b in blobs]
    if not both:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([v for v, _ in both]), np.concatenate([d for _, d in both])


def repeated(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted values, their documents, and which values stand more than once or for no single document."""
    order = np.argsort(values, kind="stable")
    values, docs = values[order], docs[order]
    if not len(values):
        return values, docs, np.empty(0, bool)
    same = values[1:] == values[:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    if (docs == 0).any():
        twice |= np.isin(values, values[docs == 0])
    return values, docs, twice


def keyed(kind: int, keys: np.ndarray, values: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One row (kind, key, blob) for each key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(kind, int(keys[part[0]]), pack(values[part], docs[part])) for part in np.split(order, cuts) if len(part)]


def as_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, key, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(blob, pa.binary())], ["kind", "key", "blob"])


ROWS = "kind int, key long, blob binary"
BUCKET, HIT, NONE = 0, 1, -1


def segment_id(seg: bytes) -> int:
    """With the class of 48 bits, the name of a segment whose text has been compared already."""
    return xxh3_64_intdigest(seg) - (1 << 63)


def pack_firsts(ords: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> bytes:
    """Runs of windows whose first document is the same and, if starts count, whose first starts follow each other."""
    at = np.flatnonzero(cuts)
    return np.stack([at, ords[at], starts[at]]).astype(np.int64).tobytes()


def unpack_firsts(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    at, ords, starts = np.frombuffer(blob, np.int64).reshape(3, -1)
    sizes = np.diff(np.append(at, n))
    return np.repeat(ords, sizes), np.repeat(starts - at, sizes) + np.arange(n)


def pack_segments(table: pa.Table, sizes: np.ndarray, ords: np.ndarray, starts: np.ndarray, within: bool) -> pa.Table:
    """From segments (cls, sid, ord, start, n) and their windows' first documents and starts in turn, the rows of ``Repeats.firsts``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - begins[owner]
    own_ord, own_start, n = (table[c].to_numpy() for c in ("ord", "start", "n"))
    other = ords != own_ord[owner]
    cuts = np.ones(len(owner), bool)
    cuts[1:] = ords[1:] != ords[:-1]
    if within:
        other |= starts != own_start[owner] + place
        cuts[1:] |= starts[1:] != starts[:-1] + 1
    else:
        starts = place
    cuts[begins] = True
    use = np.flatnonzero((n > 1) | (np.bincount(owner[other], minlength=len(sizes)) > 0))
    simple = np.bincount(owner[cuts], minlength=len(sizes))[use] == 1
    cls, sid = table["cls"].to_numpy()[use].tolist(), table["sid"].to_numpy()[use].tolist()
    out: list[tuple] = []
    for k, (b, size, one) in enumerate(zip(begins[use].tolist(), sizes[use].tolist(), simple.tolist(), strict=True)):
        if one:
            least = int(ords[b])
            blob = struct.pack("=3q", 0, least, int(starts[b]))
        else:
            part = slice(b, b + size)
            least, blob = int(ords[part].min()), pack_firsts(ords[part], starts[part], cuts[part])
        out.append((cls[k], sid[k], least, blob))
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table([pa.array(c, pa.int64() if k < 3 else pa.binary()) for k, c in enumerate(columns)], ["cls", "sid", "least", "firsts"])


class Repeats:
    """One pass of the steps over the documents' texts.

    past: (digest, ord) of texts that came in earlier passes; rows with these digests are copies as a whole. number: of the
    pass, from which its documents have their numbers; sizes: buckets and groups, if an index has fixed them.
    """

    def __init__(self, docs: DataFrame, unit: Unit, text: Column, work: Workspace, past: DataFrame | None = None, number: int = 0, sizes: tuple[int, int] | None = None):
        """text: the column of units, not null; single-spaced and trimmed for words."""
        self.unit, self.work, self.past = unit, work, past
        size = F.octet_length("text") if not unit.words else F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)
        own = docs.select("doc_id", text.alias("text"))
        digest = F.unhex(F.sha2("text", 256))
        rows = own.select("doc_id", digest.alias("digest"), size.cast("long").alias("size"), F.octet_length("text").alias("bytes"))
        self.rows = self.work.save("rows", rows)
        self.buckets, self.groups = sizes or self.sizes(self.rows.agg(F.sum("bytes")).first()[0] or 0)
        one = own.groupBy("text").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).cast("long").alias("ord"))
        if past is not None:
            one = one.withColumn("digest", digest).join(past.select("digest").hint("merge"), "digest", "left_anti")
        texts = self.work.save("texts", one.select(F.monotonically_increasing_id().alias("no"), "ord", "text"))
        doc = F.col("no") + F.lit(number * PASS + 1)
        self.texts = texts.select(doc.alias("doc"), "ord", "text", F.pmod(doc, F.lit(self.groups)).alias("g"))

    @staticmethod
    def sizes(n_bytes: int) -> tuple[int, int]:
        return max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES), max(LEAST_GROUPS, n_bytes // GROUP_BYTES)

    def blobs(self, *more: str) -> DataFrame:
        """Classes by bucket, and those known to be repeated by group (kind HIT). more: columns of texts, put before the others."""
        unit, n_buckets, n_groups = self.unit, self.buckets, self.groups
        kinds = dict(self.texts.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                table = pa.Table.from_batches([whole])
                parts = [((), table)] if not more else [((v,), table.filter(pc.equal(table[more[0]], v))) for v in pc.unique(table[more[0]]).to_pylist()]
                for extra, part in parts:
                    values, docs, own = [], [], []
                    for doc, text in zip(part["doc"].to_pylist(), pc.cast(part["text"], pa.binary()), strict=True):
                        if (r := unit.runs(text.as_py())) is not None:
                            v = np.unique(r.cls)
                            values.append(v)
                            docs.append(np.full(len(v), doc, np.int64))
                            own.append(np.isin(v, r.own) if len(r.own) else np.zeros(len(v), bool))
                    if not values:
                        continue
                    values, docs, own = map(np.concatenate, (values, docs, own))
                    order = np.argsort(values, kind="stable")
                    own = own[order]
                    values, docs, twice = repeated(values, docs)
                    hit = twice | own
                    firsts = np.r_[True, values[1:] != values[:-1]]
                    single = np.where(hit, 0, docs)
                    rows = keyed(HIT, docs[hit] % n_groups, values[hit], docs[hit])
                    rows += keyed(BUCKET, (values[firsts] % U(n_buckets)).astype(np.int64), values[firsts], single[firsts])
                    out = as_rows(rows)
                    yield pa.RecordBatch.from_arrays([*(pa.array([e] * out.num_rows, pa.int64()) for e in extra), *out.columns], [*more, *out.schema.names])

        return self.texts.select(*more, "doc", "text").mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in more) + ROWS)

    def segments(self, hits: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """From (key, blob) of kind HIT: the distinct segments of each group's documents, those of the pass or of ``texts``.

        g, cls, sid (hash of the segment), seg, ord and start of its first occurrence, n. One more row a group has class
        NONE and in seg the documents that have any.
        """
        unit = self.unit

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            values, owners = unpack_all(found["blob"])
            order = np.argsort(owners, kind="stable")
            values, owners = values[order], owners[order]
            segs: dict[bytes, list] = {}
            having: list[int] = []
            texts = pc.cast(docs["text"], pa.binary())
            for i, (doc, ordinal) in enumerate(zip(docs["doc"].to_pylist(), docs["ord"].to_pylist(), strict=True)):
                low, high = np.searchsorted(owners, doc), np.searchsorted(owners, doc, "right")
                if low == high:
                    continue
                text = texts[i].as_py()
                r = unit.runs(text)
                having.append(doc)
                for j in np.flatnonzero(np.isin(r.cls, values[low:high])).tolist():
                    piece = r.piece(text, j, unit.window)
                    here = (ordinal, int(r.first[j]))
                    if (seen := segs.get(piece)) is None:
                        segs[piece] = [int(r.cls[j]), here, 1]
                    else:
                        seen[1], seen[2] = min(seen[1], here), seen[2] + 1
            if having:
                segs[np.array(having, np.int64).tobytes()] = [NONE, (0, 0), 0]
            g, rows = docs["g"][0].as_py() if docs.num_rows else 0, segs.values()
            columns = [[g] * len(segs), [r[0] for r in rows], [segment_id(x) for x in segs], list(segs), [r[1][0] for r in rows], [r[1][1] for r in rows], [r[2] for r in rows]]
            return pa.table([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["g", "cls", "sid", "seg", "ord", "start", "n"])

        hits = hits.select(F.col("key").alias("g"), "blob")
        return (self.texts if texts is None else texts).groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(run, "g long, cls long, sid long, seg binary, ord long, start long, n long")

    def firsts(self, segments: DataFrame, verify: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        """cls, sid, least, firsts: where each window of a segment first starts, for segments that hold a repeated window.

        verify gets the distinct segments of a bucket (seg, ord, start) and gives the number of windows of each, and the
        first document and start of all their windows in turn. least is the smallest of the documents; firsts packs both.
        Classes with more than HOT segments don't go through a bucket: their windows are told apart one by one.
        """
        first = F.min(F.struct("ord", "start"))
        distinct = segments.filter(F.col("cls") != NONE).groupBy("cls", "sid", "seg").agg(first.alias("first"), F.sum("n").alias("n"))
        distinct = distinct.select("cls", "sid", "seg", "first.ord", "first.start", "n")
        hot = segments.filter(F.col("cls") != NONE).groupBy("cls").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("cls")
        within = self.unit.within

        def run(table: pa.Table) -> pa.Table:
            return pack_segments(table, *verify(table), within)

        in_buckets = lambda rows: rows.withColumn("bucket", F.pmod("cls", F.lit(self.buckets))).groupBy("bucket").applyInArrow(run, FIRSTS)
        if hot.isEmpty():
            return in_buckets(distinct)
        hot = F.broadcast(self.work.save("hot", hot))  # at most one row for each HOT segments
        return in_buckets(distinct.join(hot, "cls", "left_anti")).unionByName(self._by_window(self.work.save("spread", distinct.join(hot, "cls", "left_semi"))))

    def _by_window(self, distinct: DataFrame) -> DataFrame:
        """The same, by an aggregation over the windows' texts and a join back to the segments, which Spark can split however often a window stands."""
        unit = self.unit

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    cls, sid, seg, doc, start = (batch.column(c)[i].as_py() for c in range(5))
                    wins = unit.windows(seg)
                    n = len(wins)
                    columns = [pa.array([cls] * n, pa.int64()), pa.array([sid] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(wins, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["cls", "sid", "k", "win", "ord", "start"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                lists = batch.column(batch.schema.get_field_index("w"))
                flat = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy())
                yield from pack_segments(table, sizes, flat.field("o").to_numpy(), flat.field("s").to_numpy(), unit.within).to_batches()

        rows = self.work.save("windows", distinct.select("cls", "sid", "seg", "ord", "start").mapInArrow(explode, "cls long, sid long, k long, win binary, ord long, start long"))
        first = rows.groupBy("win").agg(F.min(F.struct("ord", "start")).alias("f"))
        placed = rows.select("cls", "sid", "k", "win").join(first.hint("merge"), "win").groupBy("cls", "sid").agg(F.sort_array(F.collect_list(F.struct("k", F.col("f.ord").alias("o"), F.col("f.start").alias("s")))).alias("w"))
        return placed.join(distinct.select("cls", "sid", "ord", "start", "n").hint("merge"), ["cls", "sid"]).mapInArrow(pack, FIRSTS)

    def outcome(self, segments: DataFrame, firsts: DataFrame) -> DataFrame:
        """doc_id, size, n_removed, n_spans, kept_sha256 for each row of the documents."""
        unit = self.unit

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            at, having = {}, set()
            for cls, sid, firsts in zip(*(found[c].to_pylist() for c in ("cls", "sid", "firsts")), strict=True):
                if cls == NONE:
                    having.update(np.frombuffer(firsts, np.int64).tolist())
                else:
                    at[cls, sid] = firsts
            known = np.unique(np.array([cls for cls, _ in at], np.uint64))
            out: list[tuple] = []
            if at:
                texts = pc.cast(docs["text"], pa.binary())
                for i, (doc, ordinal) in enumerate(zip(docs["doc"].to_pylist(), docs["ord"].to_pylist(), strict=True)):
                    if doc not in having:
                        continue
                    text = texts[i].as_py()
                    r = unit.runs(text)
                    opens: list[int] = []
                    shuts: list[int] = []
                    place = np.minimum(np.searchsorted(known, r.cls), len(known) - 1)
                    for j in np.flatnonzero(known[place] == r.cls).tolist():
                        if (hit := at.get((int(r.cls[j]), segment_id(r.piece(text, j, unit.window))))) is None:
                            continue
                        a, b = int(r.first[j]), int(r.last[j])
                        if len(hit) == 24:  # all windows first start side by side
                            _, first, start = struct.unpack("=3q", hit)
                            if first < ordinal or unit.within and first == ordinal and start < a:
                                opens.append(a)
                                shuts.append(b + unit.window)
                            continue
                        firsts, starts = unpack_firsts(hit, b - a + 1)
                        here = np.arange(a, b + 1)
                        gone = firsts < ordinal
                        if unit.within:
                            gone |= (firsts == ordinal) & (starts < here)
                        here = here[gone].tolist()
                        opens += here
                        shuts += [h + unit.window for h in here]
                    edge = None
                    if opens:
                        n = unit.count(text) + 1
                        edge = np.bincount(opens, minlength=n) - np.bincount(shuts, minlength=n)
                    if edge is not None:
                        gone = np.cumsum(edge)[:-1] > 0
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        if unit.words:
                            kept = b" ".join(w for w, x in zip(text.split(b" "), gone.tolist(), strict=True) if not x)
                        else:
                            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                        out.append((sha256(text).digest(), int(gone.sum()), spans, sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["digest", "n_removed", "n_spans", "kept_sha256"])

        having = segments.filter(F.col("cls") == NONE).select("g", "cls", "sid", F.col("seg").alias("firsts"))
        back = segments.filter(F.col("cls") != NONE).select("g", "cls", "sid", "ord", "n").join(firsts, ["cls", "sid"])
        if not unit.within:  # a first occurrence loses nothing
            back = back.filter((F.col("least") < F.col("ord")) | (F.col("n") > 1))
        back = back.select("g", "cls", "sid", "firsts").union(having)
        done = self.texts.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string")
        done = self.work.save("changed", done)
        ids = self.rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("ord"))
        if self.past is not None:
            ids = ids.join(self.past.select("digest", F.lit(True).alias("known")).hint("merge"), "digest", "left")
        else:
            ids = ids.withColumn("known", F.lit(None).cast("boolean"))
        per_text = self.work.save("per_text", ids.join(done, "digest", "left"))
        rows = self.rows.join(per_text, "digest")
        copy = (F.coalesce("known", F.lit(False)) | (F.coalesce("doc_id", F.lit(LAST)) > F.col("ord"))) & (F.col("size") >= self.unit.window)
        return rows.select(
            "doc_id", "size",
            F.when(copy, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        )
