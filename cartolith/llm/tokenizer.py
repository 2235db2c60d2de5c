"""Byte-pair encoding by prefix dynamic programming.

Every prefix of a byte string has exactly one valid last token: the one that
ends there and makes a valid pair with the last token of what is before it. The
table of last tokens gives the encoding when read backwards, and stays valid
when bytes are appended; an edit needs new entries from the edit onwards only.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's table of words; beyond it the table starts anew. It saves time, never changes a result.
CACHE = 400_000


class Encoder:
    """Encodes by a vocabulary of ranked byte strings (lines of base64 bytes and rank)."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merging step by step, for strings of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def valid_pair(self, a: int, b: int) -> bool:
        """Whether a followed by b is how their bytes are encoded."""
        if (v := self._pairs.get((a, b))) is None:
            v = self._pairs[a, b] = self._merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self._pairs) > CACHE:
                self._pairs.clear()
        return v

    def extend(self, last: list[int], data: bytes, old: list[int] | None = None, same: int = 0) -> None:
        """Adds the last token of each prefix of data from len(last) + 1 bytes on.

        old may be the table of a string that ends in the same `same` bytes: an
        entry depends on no more entries than the longest token has bytes, so once
        that many agree the others are taken over.
        """
        ranks, total, agree = self.ranks, len(data), 0
        for end in range(len(last) + 1, total + 1):
            for start in range(max(0, end - self.longest), end):
                t = ranks.get(data[start:end])
                if t is not None and (not start or self.valid_pair(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no token that ends byte {end} of {data[:40]!r}")
            if old is not None and end > total - same:
                agree = agree + 1 if old[len(old) - total + end - 1] == last[-1] else 0
                if agree >= self.longest:
                    last.extend(old[len(old) - total + end :])
                    return

    def read(self, last: list[int]) -> list[int]:
        """The encoding a table of last tokens stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(last, data)
        return self.read(last)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for an empty or null text."""
        if not text:
            return []
        words, out = self._words, []
        for w in self.pattern.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) > CACHE:
                    words.clear()
                ids = tuple(self.encode_bytes(w.encode("utf-8", "surrogatepass")))
                if len(w) <= 64:
                    words[w] = ids
            out.extend(ids)
        return out


def _shared(a: bytes, b: bytes) -> int:
    """Number of bytes that a and b begin with alike."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Encoding:
    """A text that is appended to and edited, with its ids kept up to date.

    Each word between two cuts has its bytes and its table of last tokens. A cut
    is settled once two characters follow it; a change so cuts anew from the last
    settled cut before it up to where the old cuts are met again. Of a word that
    is cut anew at the place of an old one, table entries before the change stay
    as they are, and those behind it are taken over once they agree: an append to
    one long word costs what is appended, an edit its surroundings.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.cuts, self.words = encoder, "", [], []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), 0, text)

    def replace(self, at: int, length: int, new: str) -> None:
        """Puts new in the place of length characters from at."""
        old, keep = self.cuts, bisect_right(self.cuts, at - 3)
        self.text = self.text[:at] + new + self.text[at + length :]
        moved = {c + len(new) - length: k for k, c in enumerate(old[keep:], keep) if c >= at + length}
        starts = {c: k for k, c in zip(range(keep, len(old)), [old[keep - 1] if keep else 0, *old[keep:]])}
        pos, cuts, words, rest = (old[keep - 1] if keep else 0), [], [], None
        for m in self.encoder.pattern.finditer(self.text, pos):
            cuts.append(m.end())
            words.append(self._word(m.group().encode("utf-8", "surrogatepass"), starts.get(m.start()) if m.start() <= at else None))
            if m.end() > at + len(new) and m.end() in moved:
                rest = moved[m.end()] + 1
                break
        tail = [c + len(new) - length for c in old[rest:]] if rest is not None else []
        tail_words = self.words[rest:] if rest is not None else []
        self.cuts, self.words = old[:keep] + cuts + tail, self.words[:keep] + words + tail_words

    def _word(self, data: bytes, before: int | None) -> tuple[bytes, list[int]]:
        """A word and its table, from that of the word which began there before."""
        was, table = self.words[before] if before is not None else (b"", [])
        n = _shared(was, data)
        same = _shared(was[n:][::-1], data[n:][::-1])
        last = table[:n]
        self.encoder.extend(last, data, table, same)
        return data, last

    def tokens(self) -> list[int]:
        return [t for _, table in self.words for t in self.encoder.read(table)]


_encoders: dict[str, Encoder] = {}


def worker_encoder(name: str, vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary (a broadcast of its bytes)."""
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary.value)
    return _encoders[name]


def vocabulary_of(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent once to each executor; its size is fixed (under 1 MB)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each row: one pass without shuffle over whole texts.

    An empty or null text gives an empty list; every row gives one, repeated or
    null ids included.
    """
    ship(docs.sparkSession)
    voc = vocabulary_of(docs, path)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path, voc)
        for b in batches:
            # small slices, so that lists of ids of long texts do not pile up
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = [np.array(enc.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.array([], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
