"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives bytes of tokens in merge order. Bytes map to printable characters one to one, so tokens become strings
for the library; every split of a token into two tokens is a merge, in the order of ranks. Texts are split by the pattern
once per text, and each distinct piece is encoded by the library once per worker while its memo holds it. Decoding reverses
the byte table and joins bytes before it reads characters, so a character that is split over tokens comes out whole.
"""

from __future__ import annotations

import base64
import gc
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000
#: Texts below this character are split by a pattern with the classes written out; others take the library's own splitter.
LATIN_END = "\u0370"
#: Texts of other scripts are cut into parts of about so many characters, at spaces between words, where the pattern always splits.
PART = 1 << 16
# Fixed value: the split pattern that both shortcuts are exact for.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def narrowed(pattern: str) -> re.Pattern:
    r"""The pattern for texts below LATIN_END, with \p{L}, \p{N} and \s written out as the characters they are there."""
    below = list(map(chr, range(ord(LATIN_END))))
    letters = [c for c in below if unicodedata.category(c)[0] == "L"]
    numbers = [c for c in below if unicodedata.category(c)[0] == "N"]
    spaces = [c for c in below if c.isspace() and not "\x1c" <= c <= "\x1f"]
    classes = {name: "".join(map(re.escape, chars)) for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces))}

    def inside(found: re.Match) -> str:
        body = found[2]
        for name, chars in classes.items():
            body = body.replace(name, chars)
        return f"[{found[1]}{body}]"

    bracketed = re.split(r"(\[\^?[^\]]*\])", pattern)
    for i, part in enumerate(bracketed):
        if i % 2:
            bracketed[i] = re.sub(r"^\[(\^?)(.*)\]$", inside, part)
        else:
            for name, chars in classes.items():
                part = part.replace(name, f"[{chars}]")
            bracketed[i] = part.replace(r"\S", f"[^{classes[r'\s']}]")
    return re.compile("".join(bracketed))


class ByteBPE:
    """Encoder and decoder of one rank file.

    ``shortcuts``: split texts below LATIN_END by the written-out pattern and cut long texts of other scripts into parts. Both
    hold for patterns that only join a single leading space to what follows, as KNOWN does, so they are off for any other.
    """

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.shortcuts = pattern == KNOWN
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_characters()
        spelled = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges = [
            (spelled[token[:i]], spelled[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocabulary = {spelled[token]: rank for token, rank in ranks.items()}

        def build(*steps):
            made = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
            made.pre_tokenizer = pre_tokenizers.Sequence([*steps, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            return made

        self.whole, self.piece = build(pre_tokenizers.Split(Regex(pattern), "isolated")), build()
        back = {c: b for b, c in table.items()}
        self.bytes_of = {rank: bytes(map(back.__getitem__, text)) for text, rank in vocabulary.items()}
        self.digits_of = {rank: b"%d" % rank for rank in self.bytes_of}
        self.find, self.memo, self.most = narrowed(pattern).findall if self.shortcuts else None, {}, memo

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.shortcuts:
            return self.whole.encode(text, add_special_tokens=False).ids
        if max(text) >= LATIN_END:
            return list(chain.from_iterable(self.whole.encode(part, add_special_tokens=False).ids for part in parts(text)))
        pieces = self.find(text)
        if new := set(pieces).difference(self.memo):
            if len(self.memo) + len(new) > self.most:
                self.memo.clear()
                new = set(pieces)
            self._learn(list(new))
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def _learn(self, pieces: list[str]) -> None:
        """All new pieces in one call; the library says which piece each id is of."""
        found = self.piece.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = [[] for _ in pieces]
        for i, piece in zip(found.ids, found.word_ids, strict=True):
            ids[piece].append(i)
        self.memo.update(zip(pieces, map(tuple, ids), strict=True))
        gc.freeze()  # the memo's many small objects are no garbage

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Start of each token in the UTF-8 bytes of the text."""
        lengths = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        return np.cumsum(lengths) - lengths

    def digits(self, ids: list[int]) -> bytes:
        return b",".join(map(self.digits_of.__getitem__, ids))


def parts(text: str) -> Iterator[str]:
    """The text in parts that no match of the pattern spans: each later part begins with a lone space before a non-space."""
    start = 0
    while len(text) - start > PART:
        cut = start + PART
        while (cut := text.find(" ", cut)) > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int), starts (byte offset of each token) for each row; a key of one of these names is called ``key_`` and its name.

    Null and empty texts have no tokens, null keys and repeated rows come out as they are, an empty table gives an empty result.
    A text is encoded whole, one at a time, however long.
    """
    name = f"key_{key}" if key in ("ids", "starts") else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([ids], pa.list_(pa.int32())), pa.array([bpe.offsets(ids)], pa.list_(pa.int64()))], [name, "ids", "starts"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(f"`{key}`").alias(name), F.col(f"`{text}`").alias("_chronolex_text")).mapInArrow(run, f"`{name}` {kind}, ids array<int>, starts array<bigint>")


def decode_ids(coded: DataFrame, path: str, pattern: str, *, key: str = "doc_id") -> DataFrame:
    """key, text_bytes for each row of key, ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "text_bytes"])

    kind = dict(coded.dtypes)[key]
    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text_bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: ids and decoded bytes are digested where they are made.

    Null and empty texts have no tokens and the digests of the empty string. Null doc_ids and repeated rows come out as they
    are; an empty table gives an empty result. Only doc_id and text are read, so other columns may have any name. A text is
    encoded whole, one at a time, so memory holds the longest one and its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            sizes, codes, texts = [], [], []
            for value in pc.fill_null(batch.column(1), ""):
                ids = bpe.encode(value.as_py())
                sizes.append(len(ids))
                codes.append(sha256(bpe.digits(ids)).hexdigest())
                texts.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
