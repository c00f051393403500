"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording (WAV bytes) becomes frames of twelve pitch classes. Filters over an integral image of the frames compare areas
of pitch and time; each gives two bits in Gray code, sixteen of them one packed integer for each frame. Recordings that share
pairs of neighbouring integers vote for the offset between them; at the offset with most votes the bit error over the overlap decides.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.llm.common import Workspace

RATE, FRAME, HOP, LOWEST, HIGHEST = 2756, 512, 128, 120.0, 1100.0
PITCHES, LONGEST, STEP, SILENCE = 12, 16, 0.05, 1e-3
#: (kind, lowest pitch, pitches, frames) of each filter; kinds: 0 against all pitches, 1 high against low, 2 early against late, 3 crosswise.
FILTERS = tuple((i % 4, (5 * i) % (PITCHES + 1 - h), h, w) for i in range(16) for h in ((4, 6, 12, 8)[i // 4],) for w in ((4, 8, 12, 16)[(i + i // 4) % 4],))
GRAY = np.array([0, 1, 3, 2], np.uint32)
LEAST_OVERLAP, MOST_ERROR = 8, 0.25
#: Bits, the least certain ones, of which a recording that asks also tries the other value.
WEAK = 2
LEVELS = np.array([-STEP, 0, STEP])
#: Frames that the stand-in sound of a text fills at least: as many as a fingerprint of LEAST_OVERLAP integers needs.
SPOKEN = LONGEST + FRAME // HOP + LEAST_OVERLAP


def samples_of(media: bytes | None) -> np.ndarray:
    """Mono samples at RATE; none for null, empty or unreadable media. 8- and 16-bit PCM of any rate and channels."""
    try:
        with wave.open(io.BytesIO(media or b"")) as file:
            rate, channels, width = file.getframerate(), file.getnchannels(), file.getsampwidth()
            raw = file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return np.empty(0)
    if width not in (1, 2) or not rate:
        return np.empty(0)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    x = (np.frombuffer(raw, np.uint8) - 128.0) / 128 if width == 1 else np.frombuffer(raw, "<i2") / 32768
    x = x.reshape(-1, channels).mean(axis=1)
    if rate == RATE or not len(x):
        return x
    if rate > RATE:  # a running mean takes off what the lower rate cannot hold
        n = max(1, round(rate / RATE))
        x = np.convolve(x, np.ones(n) / n, "same")
    return np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


@lru_cache(maxsize=1)
def _pitch_of_bins() -> np.ndarray:
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hertz >= LOWEST) & (hertz <= HIGHEST)
    pitch = np.zeros((len(hertz), PITCHES), np.float32)
    pitch[np.flatnonzero(use), np.round(12 * np.log2(hertz[use] / 440)).astype(int) % PITCHES] = 1
    return pitch


def chroma(samples: np.ndarray) -> np.ndarray:
    """[frame, pitch class]: each frame has length one, or is zero where it is silent."""
    if len(samples) < FRAME:
        return np.empty((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    strength = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) @ _pitch_of_bins()
    size = np.linalg.norm(strength, axis=1, keepdims=True)
    return np.where(size > SILENCE * FRAME, strength / np.maximum(size, 1e-9), 0)


def packed(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 32-bit integer for each frame that has LONGEST - 1 frames after it, whether any of those sounds, and the same integers
    with one of their WEAK least certain bits turned each: a level next to a threshold differs from that beyond it by one bit."""
    n = len(frames) - LONGEST + 1
    if n < 1:
        return np.empty(0, np.uint32), np.empty(0, bool), np.empty((WEAK, 0), np.uint32)
    image = np.zeros((len(frames) + 1, PITCHES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def mean(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return (image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]) / ((t1 - t0) * (y1 - y0))

    codes = np.zeros(n, np.uint32)
    doubt, turn = np.empty((len(FILTERS), n)), np.empty((len(FILTERS), n), np.uint32)
    for i, (kind, y, h, w) in enumerate(FILTERS):
        my, mt = y + h // 2, w // 2
        if kind == 0:
            a, b = mean(0, w, y, my), mean(0, w, 0, PITCHES)
        elif kind == 1:
            a, b = mean(0, w, my, y + h), mean(0, w, y, my)
        elif kind == 2:
            a, b = mean(0, mt, y, y + h), mean(mt, w, y, y + h)
        else:
            a, b = mean(0, mt, y, my) + mean(mt, w, my, y + h), mean(mt, w, y, my) + mean(0, mt, my, y + h)
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        codes = (codes << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, value, "right")]
        far = np.abs(value[:, None] - LEVELS)
        near = far.argmin(axis=1)
        doubt[i] = far[t, near]
        turn[i] = (GRAY[near] ^ GRAY[near + 1]) << np.uint32(2 * (len(FILTERS) - 1 - i))
    weakest = np.argpartition(doubt, WEAK, axis=0)[:WEAK]
    return codes, mean(0, LONGEST, 0, PITCHES) > 0, codes ^ np.take_along_axis(turn, weakest, axis=0)


def fingerprint(media: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed integers (as int32), the places at which a new integer begins that is not silence, and there the WEAK turned
    integers, one place after the other."""
    codes, sounds, turned = packed(chroma(samples_of(media)))
    new = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.empty(0, bool)
    marks = np.flatnonzero(new & sounds).astype(np.int32)
    return codes.view(np.int32), marks, np.ascontiguousarray(turned[:, marks].T).view(np.int32).ravel()


def fingerprints(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns, then _chronolex_codes, _chronolex_marks and _chronolex_turned (see ``fingerprint``); recordings that are null, unreadable or shorter than the longest filter have empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(m.as_py()) for m in batch.column(batch.num_columns - 1)]
            arrays = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "_chronolex_codes", "_chronolex_marks", "_chronolex_turned"])

    kinds = {c: k for c, k in media.dtypes if c != column}
    rows = media.select(*[F.col(f"`{c}`") for c in kinds], F.col(f"`{column}`"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "_chronolex_codes array<int>, _chronolex_marks array<int>, _chronolex_turned array<int>"]))


def _part(codes: Column, start: Column, n: Column) -> Column:
    return F.slice(codes, (start + 1).cast("int"), n.cast("int"))


def alignments(classes: DataFrame) -> DataFrame:
    """From (id, asks, codes, marks, turned), one row for each distinct fingerprint: id, other, offset, votes, overlap, error.

    For each id that asks, every other one that shares a pair of neighbouring marks, both integers and the frames between them, and
    whose bit error at the offset with most such votes is at most MOST_ERROR. Pairs are the join key, as single integers are far
    too common. offset: frames by which the place in the other recording is later. Ties of votes go to the smaller error, then
    distance, then offset. A recording of one steady tone has one mark and matches nothing but its own class.
    """
    pairs = classes.filter(F.size("marks") > 1).select("*", F.explode(F.sequence(F.lit(0), F.size("marks") - 2)).alias("i"))
    at = lambda k: F.get("marks", F.col("i") + k)
    code = lambda k: F.element_at("codes", at(k) + 1)
    tried = lambda k: F.concat(F.array(code(k)), F.slice("turned", (F.col("i") + k) * WEAK + 1, F.lit(WEAK)))
    index = pairs.select(F.col("id").alias("other"), at(0).alias("at"), code(0).alias("one"), code(1).alias("two"), (at(1) - at(0)).alias("gap"))
    ask = pairs.filter("asks").select("id", at(0).alias("own"), (at(1) - at(0)).alias("gap"), F.explode(tried(0)).alias("one"), tried(1).alias("two")).withColumn("two", F.explode("two"))
    votes = ask.join(index, ["one", "two", "gap"]).filter("id != other").groupBy("id", "other", (F.col("at") - F.col("own")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.withColumn("most", F.max("votes").over(Window.partitionBy("id", "other"))).filter("votes = most").drop("most")
    best = best.join(classes.select("id", F.col("codes").alias("mine")).hint("merge"), "id").join(classes.select(F.col("id").alias("other"), "codes").hint("merge"), "other")
    skip, late = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    best = best.withColumn("overlap", F.least(F.size("mine") - skip, F.size("codes") - late)).filter(F.col("overlap") >= LEAST_OVERLAP)
    bits = F.zip_with(_part(F.col("mine"), skip, F.col("overlap")), _part(F.col("codes"), late, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    best = best.withColumn("error", F.aggregate(bits, F.lit(0), lambda s, b: s + b) / (32 * F.col("overlap"))).filter(F.col("error") <= MOST_ERROR)
    order = F.struct("error", F.abs("offset").alias("distance"), "offset", "votes", "overlap")
    return best.groupBy("id", "other").agg(F.min(order).alias("b")).select("id", "other", "b.offset", "b.votes", "b.overlap", "b.error")


def match_recordings(media: DataFrame, keys: list[str], asks: Column, column: str = "media") -> DataFrame:
    """One row for each row of ``media``: the keys, n_codes, class_id, class_size, asks, n_matches, best_class, offset, votes, bit_error.

    Recordings with equal fingerprints are one class; its id is the SHA-256 of the fingerprint. Classes with a recording that
    asks are aligned with all other classes; n_matches counts those that match, best_class has the least bit error (then
    most votes, then smallest id), null where none matches or nobody asks. A recording without a fingerprint has a null
    class_id, is alone and matches nothing. Repeated rows and null keys come out as they are; ``asks`` null counts as false; an
    empty table gives an empty result. A key named as a column of the result is called ``key_`` and its name.
    """
    work = Workspace(media.sparkSession, "media")
    made = ("n_codes", "class_id", "class_size", "asks", "n_matches", "best_class", "offset", "votes", "bit_error")
    names = {c: f"_chronolex_key_{i}" for i, c in enumerate(keys)}
    own = media.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(asks, F.lit(False)).alias("_chronolex_asks"), F.col(f"`{column}`").alias("_chronolex_media"))
    rows = fingerprints(own, "_chronolex_media").withColumnsRenamed({"_chronolex_codes": "codes", "_chronolex_marks": "marks", "_chronolex_turned": "turned", "_chronolex_asks": "asks"})
    name = F.when(F.size("codes") > 0, F.sha2(F.array_join(F.transform("codes", lambda c: F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), ","), 256))
    rows = work.save("prints", rows.withColumn("class_id", name))
    classes = rows.filter("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"), F.max("asks").alias("asks"), F.first("codes").alias("codes"), F.first("marks").alias("marks"), F.first("turned").alias("turned"))
    classes = work.save("classes", classes)
    found = alignments(classes.select(F.col("class_id").alias("id"), "asks", "codes", "marks", "turned"))
    order = F.struct("error", (-F.col("votes")).alias("least_votes"), "other", "offset", "votes")
    summary = work.save("matches", found.groupBy("id").agg(F.count(F.lit(1)).alias("n_matches"), F.min(order).alias("best")))
    per_class = classes.select("class_id", "class_size").join(summary.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = rows.select(*names.values(), "asks", F.size("codes").alias("n_codes"), "class_id").join(per_class, "class_id", "left")
    mine = lambda c: F.when(F.col("asks"), c)
    return out.select(
        *[F.col(n).alias(f"key_{c}" if c in made else c) for c, n in names.items()],
        "n_codes", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), "asks", mine(F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        mine(F.col("best.other")).alias("best_class"), mine(F.col("best.offset")).alias("offset"), mine(F.col("best.votes")).alias("votes"), mine(F.col("best.error")).alias("bit_error"),
    )


@lru_cache(maxsize=1)
def _chords() -> np.ndarray:
    """[low note, high note, sample]: HOP samples of two tones; the last of each row of notes leads into silence smoothly."""
    notes = 220.0 * 2 ** (np.arange(24) / 12)
    tone = np.sin(2 * np.pi * notes[:, None] * np.arange(HOP) / RATE) * np.hanning(HOP)
    return ((tone[:, None] + 0.7 * tone[None]) * 9000).astype(np.int16)


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def voiced(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, media: a stand-in recording of each text, two tones for each word, or as many times them as SPOKEN frames take, so that
    short texts have a fingerprint too. Null and empty texts have a recording without samples."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    notes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(576)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # sound is some hundred times as large as its notes
                batch, sound = whole.slice(at, 64), []
                for row in batch.column(batch.num_columns - 1):
                    notes = np.array(row.values, np.int64)
                    notes = np.repeat(notes, max(1, -(-SPOKEN // max(1, len(notes)))))
                    sound.append(wav(_chords()[notes // 24, notes % 24].ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sound, pa.binary())], [*keys, "media"])

    kinds = dict(texts.dtypes)
    return texts.select(*keys, notes.alias("notes")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", media binary")
