"""Held-out passages inside a training corpus.

Every item becomes a list of normalised words, and every run of three of them
a keyword of one Aho-Corasick automaton.  Each text is normalised and read by
the automaton once; a keyword's place gives word numbers in the text and in the
items that have it, and word numbers give offsets in the original text.  The
automaton is a filter that altered words cannot break: items with enough hits
close together are then aligned word by word around the hits.  A chain goes
forward in both, may skip an altered word, and may jump over a page header in
the text; of all chains that end at a pair of words those are kept that no other
one beats in both length and agreement.  A passage counts if its chain covers
enough consecutive words of the item and nearly all of them agree.

Normalisation: compatibility decomposition without accents, case folded; a
word goes on across a hyphen, an apostrophe, a point or a comma between two
letters or digits, and across a hyphen at a line's end; all other punctuation
and white space only separates words.

Up to ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, counted first, are
sent to the executors.  More of them never leave the cluster: of every window of
an item the rarest runs are kept, so many that a passage of the window holds one
of them at least (those a passage may lack, and one more), the corpus is
read once for its runs, of which a bit map of fixed size drops most, and the rest
is joined with the kept ones; texts and items that share one are aligned alike.
Either way the corpus is scanned once to find candidates.

Defined results
* Null and empty texts and items match nothing.  Items shorter than a passage
  must be contained whole (all words, the same tolerance).
* An item id with several texts is contained if one of them is; the longest
  passage of each of its texts is reported.
* Every row is searched by itself: repeated rows give repeated cases.
* Whole texts are read, whatever their length; empty tables give no rows;
  columns other than id and text are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint, spread

#: Words of a passage; the edges may be altered words, so two fewer must be covered.
PASSAGE_WORDS = 20
#: Least share of the covered item words that agree.
AGREEMENT = 0.92
#: Words of a page header that a chain may jump over, and words between hits of one region.
HEADER_WORDS = 16
REGION_WORDS = 60
#: Words of a keyword, and the item words in which hits must lie close together.
GRAM = 3
WINDOW = 20
#: Item words between two words of a chain, and text words a chain's next word may be away.
BACK = 3
REACH = HEADER_WORDS + 3
#: Bounds of what is broadcast: items and their characters, bits of the map of runs.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000
MAP_BITS = 1 << 26

_MARK = "̀-ͯ­​-‍⁠﻿"
WORD = re.compile(rf"[^\W_][\w{_MARK}]*(?:(?:[-‐‑¬­][ \t]*[\r\n]+[ \t]*|[-‐‑'’.,])[^\W_][\w{_MARK}]*)*")
_DROP = re.compile(r"[^\w\x1f]+|_")
#: Letters that have no decomposition.
_LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "þ": "th"}
_LETTER = re.compile("[æœøđðłıþ]")


def normal_words(tokens: Sequence[str]) -> list[str]:
    """Normal forms of words, one each (possibly empty)."""
    joined = "\x1f".join(tokens)
    if joined.isascii():
        joined = joined.lower()
    else:
        joined = unicodedata.normalize("NFKD", joined).casefold()
        joined = _LETTER.sub(lambda m: _LETTERS[m[0]], joined)
    return _DROP.sub("", joined).split("\x1f") if tokens else []


def least_hits(size: int) -> int:
    """Keywords that a passage of ``size`` item words keeps: each altered word breaks three, a page header two."""
    covered = {min(size, WINDOW), min(size, PASSAGE_WORDS - 2)}  # the edges may be altered, too
    return max(1, min(n - GRAM + 1 - GRAM * int(n * (1 - AGREEMENT) + 1e-9) - (GRAM - 1) for n in covered))


def _places(item: list[str]) -> dict[str, list[int]]:
    where: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    return where


class Matcher:
    """The automaton of a bounded number of items; an id may have several texts."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        import ahocorasick

        self.ids: list[int] = []
        self.words: list[list[str]] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = [w for w in normal_words(WORD.findall(text or "")) if w]
            if not words:
                continue
            self.ids.append(item)
            self.words.append(words)
            size = min(GRAM, len(words))
            for i in range(len(words) - size + 1):
                places[f" {' '.join(words[i : i + size])} "].append((len(self.words) - 1, i))
        self.automaton = ahocorasick.Automaton()
        for number, gram in enumerate(places):
            self.automaton.add_word(gram, number)
        self.extra = np.array([g.count(" ") - 2 for g in places], dtype=np.int64)
        self.many = np.array([len(at) for at in places.values()], dtype=np.int64)
        self.first = np.cumsum(self.many) - self.many
        flat = np.array([p for at in places.values() for p in at], dtype=np.int64).reshape(-1, 2)
        self.item, self.place = flat[:, 0], flat[:, 1]
        self.need = np.array([least_hits(len(w)) for w in self.words], dtype=np.int64)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def passages(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """``(item, first and last item word, start and end offset)`` of each item's longest passage."""
        if not text or self.empty:
            return []
        tokens = WORD.findall(text)
        if not tokens:
            return []
        words = normal_words(tokens)
        found = list(self.automaton.iter(f" {' '.join(words)} "))
        if not found:
            return []
        end, gram = np.array(found, dtype=np.int64).T
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        starts = np.cumsum(length) - length + 1
        word = np.searchsorted(starts, end - 1, side="right") - 1 - self.extra[gram]
        many = self.many[gram]  # every hit, for every place of its keyword in the items
        each = np.repeat(np.arange(len(gram)), many)
        at = np.arange(len(each)) - (np.cumsum(many) - many)[each] + self.first[gram][each]
        item, place, word = self.item[at], self.place[at], word[each]
        enough = np.bincount(item, minlength=len(self.ids)) >= self.need
        out = []
        spans: list[tuple[int, int]] | None = None
        for n in np.flatnonzero(enough).tolist():
            own = self.words[n]
            mine = item == n
            hit = np.zeros(len(own) + 1, dtype=np.int64)
            hit[place[mine] + 1] = 1
            total = np.cumsum(hit)
            if (total[min(WINDOW, len(own)) :] - total[: len(total) - min(WINDOW, len(own))]).max() < self.need[n]:
                continue
            best = align(own, words, word[mine].tolist())
            if best is not None:
                if spans is None:
                    spans = [m.span() for m in WORD.finditer(text)]
                first, last, start, stop = best
                out.append((self.ids[n], first, last, spans[start][0], spans[stop][1]))
        return out


Passage = tuple[int, int, int, int]


def align(item: list[str], words: list[str], at: list[int]) -> Passage | None:
    """The item's longest passage around the hits ``at`` of the text: item words first..last, text words first..last."""
    need = min(PASSAGE_WORDS - 2, len(item))
    where = _places(item)
    best = None
    region: list[int] = []
    for j in [*sorted(at), 1 << 60]:
        if region and j - region[-1] > REGION_WORDS:
            found = _chain(where, len(item), words, max(0, region[0] - PASSAGE_WORDS), min(len(words), region[-1] + PASSAGE_WORDS + GRAM), need)
            if found and (best is None or found[1] - found[0] > best[1] - best[0]):
                best = found
            region = []
        region.append(j)
    return best


#: First item word, merit, whether a header was jumped over, first text word.
Chain = tuple[int, float, bool, int]


def _unbeaten(chains: list[Chain]) -> list[Chain]:
    """Chains that no other one beats: begun as early, of as much merit, with a jump as well to spare."""
    chains.sort(key=lambda c: (c[0], -c[1], c[2], -c[3]))
    out: list[Chain] = []
    for c in chains:
        if all(c[1] > o[1] + 1e-9 or c[2] < o[2] for o in out):
            out.append(c)
    return out


def _chain(where: dict[str, list[int]], size: int, words: list[str], lo: int, hi: int, need: int) -> Passage | None:
    """The longest passage among all chains.

    A chain that begins at item word ``f`` with ``m`` agreeing words has the
    merit ``m + AGREEMENT * f``: it agrees enough at item word ``i`` if its
    merit reaches ``AGREEMENT * (i + 1)``, wherever it began.  One jump over a
    header is free, every other one is paid with the word behind it.
    """
    ends: list[list[tuple[int, list[Chain]]]] = [[] for _ in range(size)]
    best = None
    for j in range(lo, hi):
        fresh = []
        for i in where.get(words[j], ()):
            chains = [(i, 1 + AGREEMENT * i, False, j)]
            for back in range(1, min(BACK, i) + 1):
                for before, front in ends[i - back]:
                    if j - before <= REACH:
                        jump = j - before > BACK + 1
                        chains += [(f, merit + (not (jump and jumped)), jumped or jump, t) for f, merit, jumped, t in front]
            front = chains if len(chains) == 1 else _unbeaten(chains)
            fresh.append((i, front))
            for f, merit, _, t in front:  # the earliest beginning first
                if i - f + 1 < need:
                    break
                if merit >= AGREEMENT * (i + 1) - 1e-9:
                    if best is None or i - f > best[1] - best[0]:
                        best = (f, i, t, j)
                    break
        for i, front in fresh:
            own = ends[i]
            while own and j - own[0][0] >= REACH:
                own.pop(0)
            own.append((j, front))
    return best


def _pairs_of(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, int, int, int] | None]:
    """First and last item word, start and end offset of each text and item, None where there is no passage."""
    last: tuple[str, list, list] = ("", [], [])
    for text, item in rows:
        if text != last[0]:
            spans = [m.span() for m in WORD.finditer(text)]
            last = (text, spans, normal_words([text[a:b] for a, b in spans]))
        _, spans, words = last
        own = [w for w in normal_words(WORD.findall(item)) if w]
        size = min(GRAM, len(own))
        keywords = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        hits = [j for j in range(len(words) - size + 1) if tuple(words[j : j + size]) in keywords]
        found = align(own, words, hits) if own and len(hits) >= least_hits(len(own)) else None
        yield None if found is None else (found[0], found[1], spans[found[2]][0], spans[found[3]][1])


class _Runs:
    """64-bit hashes of the runs of words of a text."""

    def __init__(self) -> None:
        self.memory: dict[str, int] = {}

    def __call__(self, words: Sequence[str], size: int) -> np.ndarray:
        if len(words) < size:
            return np.empty(0, dtype=np.int64)
        import xxhash

        if len(self.memory) > 1 << 18:
            self.memory.clear()
        get, out = self.memory.get, np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = self.memory[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        run = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            run = (run ^ out[i : len(out) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
        return run.view(np.int64)


def _rarest(frequency: np.ndarray, words: int) -> np.ndarray:
    """Places of the runs to keep: of every window so many of the rarest that a passage cannot lack them all."""
    width = min(WINDOW, words) - min(GRAM, words) + 1
    spare = width - least_hits(words) + 1
    rank = np.lexsort((np.arange(len(frequency)), frequency))
    order = np.empty(len(rank), dtype=np.int64)
    order[rank] = np.arange(len(rank))
    windows = np.lib.stride_tricks.sliding_window_view(order, width)
    least = np.partition(windows, spare - 1, axis=1)[:, :spare]
    return rank[np.unique(least)]


def _batch(found: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(arrow), arrow)], schema=arrow)


def _candidates(rows: DataFrame, stated: DataFrame, map_bits: int) -> DataFrame:
    """``h`` (hash of text) and ``n`` (hash of item) of texts and items that share a kept run."""
    arrow = pa.schema([("n", pa.int64()), ("size", pa.int32()), ("words", pa.int32()), ("place", pa.int32()), ("run", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Runs()
        for batch in batches:
            out = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in normal_words(WORD.findall(text)) if w]
                size = min(GRAM, len(words))
                out += [(n, size, len(words), i, r) for i, r in enumerate(hashed(words, size).tolist())] if words else []
            yield _batch(out, arrow)

    all_runs = spread(stated.select("n", "own").dropDuplicates(["n"])).mapInArrow(runs, "n bigint, size int, words int, place int, run bigint")
    counted = all_runs.groupBy("run").agg(F.count(F.lit(1)).alias("c"))
    listed = all_runs.join(counted, "run").groupBy("n", "size", "words").agg(F.sort_array(F.collect_list(F.struct("place", "run", "c"))).alias("runs"))
    kept_arrow = pa.schema([("n", pa.int64()), ("size", pa.int32()), ("run", pa.int64())])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, size, words, of in zip(*[c.to_pylist() for c in batch.columns]):
                hashes, frequency = np.array([x["run"] for x in of], dtype=np.int64), np.array([x["c"] for x in of], dtype=np.int64)
                out += [(n, size, r) for r in np.unique(hashes[_rarest(frequency, words)]).tolist()]
            yield _batch(out, kept_arrow)

    ensure_checkpoint(rows.sparkSession)
    keys = listed.mapInArrow(rarest, "n bigint, size int, run bigint").checkpoint()
    slot = F.pmod(F.col("run"), F.lit(map_bits))
    cells = keys.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(run, {map_bits}) % 64 as int))")).alias("bits"))
    cells = cells.toArrow()  # at most map_bits / 64 rows
    bits = np.zeros(-(-map_bits // 64), dtype=np.int64)
    bits[np.asarray(cells["cell"])] = np.asarray(cells["bits"])
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # 1 to GRAM
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    hit_arrow = pa.schema([("h", pa.int64()), ("run", pa.int64())])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, map_ = _Runs(), sent.value
        for batch in batches:
            ids, found = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normal_words(WORD.findall(text))
                for size in sizes:
                    run = np.unique(hashed(words, size))
                    at = run % map_bits
                    run = run[(map_[at >> 6] >> (at & 63)) & 1 == 1]
                    ids.append(np.full(len(run), h, dtype=np.int64))
                    found.append(run)
            columns = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (ids, found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=hit_arrow)

    read = rows.select("h", "t").mapInArrow(hits, "h bigint, run bigint")
    return read.join(keys.select("n", "run"), "run").select("h", "n").distinct()


def leaked_passages(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, map_bits: int = MAP_BITS
) -> DataFrame:
    """``key``, ``item_key``, ``first_word``, ``last_word`` (of the item), ``start``, ``end`` (code points of the text)."""
    stated = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("own")).dropna().distinct()
    rows = spread(corpus.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull()))
    n, chars = stated.agg(F.count(F.lit(1)), F.sum(F.length("own"))).collect()[0]
    fields = ("first_word", "last_word", "start", "end")
    schema = "k bigint, item bigint, first_word int, last_word int, start int, end int"
    arrow = pa.schema([("k", pa.int64()), ("item", pa.int64()), *((f, pa.int32()) for f in fields)])
    if n <= block_items and (chars or 0) <= block_chars:
        sent = corpus.sparkSession.sparkContext.broadcast([tuple(r) for r in stated.orderBy("item", "own").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                yield _batch([(k, *p) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in matcher.passages(t)], arrow)

        return rows.mapInArrow(run, schema).toDF(key, item_key, *fields)

    # texts and items meet by two hashes of what they say
    rows = rows.withColumn("h", F.xxhash64("t"))
    stated = stated.withColumn("n", F.xxhash64("own"))
    shared = _candidates(rows, stated, map_bits)
    found = rows.join(shared, "h").join(stated, "n").select("k", "item", "t", "own")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, item, texts, own = (c.to_pylist() for c in batch.columns)
            yield _batch([(k[i], item[i], *p) for i, p in enumerate(_pairs_of(zip(texts, own))) if p is not None], arrow)

    return found.mapInArrow(aligned, schema).toDF(key, item_key, *fields)
