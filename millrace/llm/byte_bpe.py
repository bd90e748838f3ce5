"""Corpus encoding by a public byte-level BPE vocabulary.

The texts of an Arrow batch form one byte buffer.  The vocabulary's split
pattern has a boundary wherever a visible character is followed by white space
and before the last white-space character ahead of a visible one, in any
text; array operations find those places, and the pieces between them are
dictionary-encoded.  Only the distinct pieces of a batch are looked up in a
bounded table of the worker, and only a new one is cut by the pattern and
merged: a priority queue holds the possible merges by rank over a doubly linked
list of symbols; a popped entry whose symbols have changed meanwhile is stale
and skipped.  The ids of all pieces are then gathered as arrays.

Defined results
* An empty and a null text give an empty list.
* Special tokens do not exist: their strings are ordinary text.
* Whole texts of any length are encoded; repeated rows give repeated results;
  an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Folder of the public vocabularies; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary, white space spelt as the Unicode property.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces (and pattern matches) a worker remembers, and bytes of text encoded at once.
REMEMBERED = 150_000
SLICE = 1 << 23
#: Pieces longer than this are not remembered.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 string and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pattern match."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i, size = heapq.heappop(queue)
        left = symbol[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(symbol[j]) != size:
            continue  # stale: one of the two has been merged since
        merged = left + symbol[j]
        symbol[i], symbol[j] = merged, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(merged + symbol[k])) is not None:
                heapq.heappush(queue, (r, i, size + len(symbol[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(symbol[h] + merged)) is not None:
            heapq.heappush(queue, (r, h, len(symbol[h]) + size))
    return [ranks[s] for s in symbol if s is not None]


def white_space(data: np.ndarray) -> np.ndarray:
    """Marks every byte of a white-space character of UTF-8 data."""
    ws = (data == 32) | ((data >= 9) & (data <= 13))
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], (0x85, 0xA0))]
    ws[two] = ws[two + 1] = True
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    code = (data[lead].astype(np.int64) & 15) << 12 | (data[lead + 1].astype(np.int64) & 63) << 6 | (data[lead + 2].astype(np.int64) & 63)
    wide = lead[np.isin(code, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    for i in range(3):
        ws[wide + i] = True
    return ws


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that begin at ``starts`` (ascending, inside the data)."""
    n = len(data)
    ws = white_space(data)
    text = np.zeros(n, dtype=bool)
    text[starts] = True
    bound = text.copy()
    bound[1:] |= ws[1:] & ~ws[:-1]
    word = np.flatnonzero(~ws[1:] & ws[:-1] & ~text[1:]) + 1  # visible, after white space of its own text
    last = data[word - 1]
    bound[word[last != 32]] = True
    wide = np.where(last < 0x80, 1, np.where(data[np.maximum(word - 2, 0)] == 0xC2, 2, 3))
    bound[word - wide] = True
    return np.flatnonzero(bound)


class Encoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = REMEMBERED) -> None:
        import regex

        self.ranks, self.remembered = ranks, remembered
        self.split = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: bytes) -> bytes:
                found = encoder._piece(piece)
                if len(piece) <= LONG:
                    if len(self) >= encoder.remembered:
                        self.clear()
                    self[piece] = found
                return found

        self.pieces = Pieces()
        self._strings: list[bytes] | None = None

    def _piece(self, piece: bytes) -> bytes:
        ids: list[int] = []
        words, ranks = self.words, self.ranks
        for word in self.split(piece.decode("utf-8")):
            found = words.get(word)
            if found is None:
                found = merge_word(word.encode("utf-8"), ranks)
                if len(word) <= LONG:
                    if len(words) >= self.remembered:
                        words.clear()
                    words[word] = found
            ids += found
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ends of each text's ids after a leading zero."""
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join([t for t in texts.cast(pa.binary()).to_pylist() if t]), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        bounds = cut(data, ends[:-1][size > 0])
        offsets = np.append(bounds, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = list(map(self.pieces.__getitem__, pieces.dictionary.to_pylist()))
        length = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) >> 2
        flat = np.frombuffer(b"".join(codes), dtype=np.int32)
        first = np.cumsum(length) - length
        which = np.asarray(pieces.indices)
        each = length[which]
        total = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(first[which] - total[:-1], each) + np.arange(total[-1])
        return flat[at], total[np.searchsorted(bounds, ends)]

    def decode(self, ids: list[int]) -> str:
        """Concatenates the strings of the ids."""
        if self._strings is None:
            self._strings = [b""] * (max(self.ranks.values()) + 1)
            for s, r in self.ranks.items():
                self._strings[r] = s
        strings = self._strings
        return b"".join([strings[i] for i in ids]).decode("utf-8")


_ENCODERS: dict[int, Encoder] = {}


def _shared(broadcast) -> Encoder:
    """One encoder a worker, kept between tasks."""
    if broadcast.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[broadcast.id] = Encoder(broadcast.value)
    return _ENCODERS[broadcast.id]


class _Vocabulary:
    """Bytes of a vocabulary file, with an id for the worker's table.

    Its size is that of the file, which does not depend on any data.
    """

    def __init__(self, df: DataFrame, path: str) -> None:
        self.id = path
        self._ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @property
    def value(self) -> dict[bytes, int]:
        return self._ranks.value


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + SLICE)))
        yield start, stop
        start = stop


def encode_texts(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    vocabulary = _Vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared(vocabulary)
        for batch in batches:
            for start, stop in _slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                flat, ends = encoder.encode(part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    return spread(rows).mapInArrow(run, f"k {kind}, ids array<int>").toDF(key, "ids")


def decode_ids(df: DataFrame, key: str, ids: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``key`` and ``text`` of every list of ids; a null list gives a null text."""
    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    kind = rows.schema[0].dataType.simpleString()
    vocabulary = _Vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "t"])

    return rows.mapInArrow(run, f"k {kind}, t string").toDF(key, "text")
