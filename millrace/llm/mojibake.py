"""Text that was read under a wrong character encoding.

1. Twins.  All words of the fields (URLs below their percent-escapes) are
   counted; words with non-ASCII characters are joined by the text without
   those characters, each with the words of its group that have at least
   ``CLEAN_SHARE`` of the group's words of their script, counted over different
   field values, if their lengths allow a transformation.  So the pairs grow with
   the words, not with their square, and a hot value or a frequent script takes no
   twin from another.  Words without ASCII letters have no such text: they are
   joined by the order in which their characters repeat, one, two or three
   characters of the garbled word to one of the clean word.
2. Alignment.  The ASCII parts of twins are equal, so their other characters
   align.  A pair supports every (meant encoding, read encoding) under which
   clean and garbled word are the same bytes, once or repeatedly; all text
   encodings of the Python library that agree with ASCII are tried.
   Of the ``COMMON`` encodings all that enough pairs support are learned; of the
   others those that enough pairs need, which no learned one explains.
3. Restoration.  Every different word is taken back through the learned
   transformations.  Text meant as UTF-8 proves itself: the bytes must form
   valid sequences and give letters.  Single-byte text does not, so there the
   result must be a word of the corpus, and more frequent than what stands there,
   by occurrences or by the number of different field values.  Restored words are
   joined with the counts of all words, so none is too rare to prove a repair.
4. Application.  Up to ``SENT_WORDS`` garbled words, counted first, are sent to
   the executors; more are joined with the words of the fields.  Both give the
   same rows.

Defined results
* A field with a replacement character has lost characters and is affected,
  whatever else it holds (nothing can be inferred for it); lost characters stay
  as they are in the repaired text.
* Null, empty and ASCII fields are never affected.  Correct percent-escapes,
  symbols and character entities are no case.
* Repeated rows of an id and field give one case; a null id is an id.
* Repaired URLs keep their escapes, other parts stay byte for byte.
* An empty table gives no rows; columns not named are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from encodings.aliases import aliases
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint, spread

#: Common encodings that text may have been read under, or been meant in.
READ_AS = ("cp1252", "latin_1", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic")
MEANT = ("utf_8", "cp1251", "koi8_r", "cp1250", "cp1252", "cp1253", "cp1254", "iso8859_5", "iso8859_7", "cp866", "mac_cyrillic")
COMMON = frozenset((m, r) for m in MEANT for r in READ_AS)
ROUNDS = 3
#: Different twins a transformation needs, and the share of its group's words that a clean twin has.
SUPPORT = 3
CLEAN_SHARE = 1e-3
#: Least characters of a clean word that is joined by their order alone, and occurrences of a word that can prove a repair.
ORDERED = 4
KNOWN = 2
#: Garbled words that are sent to the executors at most.
SENT_WORDS = 200_000

LOST = "\ufffd"
_SPLIT = r"[\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_CUT = re.compile(r"([\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+)")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Letters, marks and symbols that are assigned.
_GRAPHIC = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "So", "Sc", "Sm"))
_MARKS = frozenset("’‘“”„–—…€™°№«»·•ªº¡¿£§")


@lru_cache(maxsize=None)
def encodings() -> tuple[str, ...]:
    """Text encodings that agree with ASCII, the common ones first."""
    ascii_text = bytes(range(32, 127))

    def agrees(name: str) -> bool:
        try:
            more = bytes(range(0xA1, 0xFF)).decode(name, "ignore")
            return ascii_text.decode(name) == ascii_text.decode("ascii") and (name == "utf_8" or any(c.isalpha() and not c.isascii() for c in more))
        except (LookupError, UnicodeError):
            return False

    rank = {n: i for i, n in enumerate(dict.fromkeys(("utf_8", *READ_AS, *MEANT)))}
    return tuple(sorted(filter(agrees, set(aliases.values()) | set(rank)), key=lambda n: (rank.get(n, len(rank)), n)))


@lru_cache(maxsize=None)
def _single(encoding: str) -> bool:
    """Whether every byte is a character of its own."""
    try:
        return len(bytes(range(0xA1, 0xFF)).decode(encoding, "replace")) == 0xFF - 0xA1 and encoding != "utf_8"
    except UnicodeError:
        return False


@lru_cache(maxsize=None)
def _tables(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; a byte without character reads as the control of its number."""
    forward = []
    for b in range(256):
        try:
            forward.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            forward.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(forward):
        back.setdefault(c, b)
    return forward, back


def garble(text: str, meant: str, read: str) -> str | None:
    """What a reader under ``read`` sees of text written in ``meant``."""
    try:
        data = text.encode(meant)
        return "".join([_tables(read)[0][b] for b in data]) if _single(read) else data.decode(read)
    except UnicodeError:
        return None


def _bytes(text: str, read: str) -> bytes | None:
    """The bytes that a reader under ``read`` has seen."""
    try:
        if _single(read):
            table = _tables(read)[1]
            return bytes([table[c] for c in text])
        return text.encode(read)
    except (KeyError, UnicodeError):
        return None


def restore(text: str, meant: str, read: str) -> str | None:
    """The text that was meant, None if the bytes are not of that encoding."""
    data = _bytes(text, read)
    try:
        return None if data is None else data.decode(meant)
    except UnicodeError:
        return None


@lru_cache(maxsize=1 << 14)
def _writings(clean: str) -> dict[bytes, tuple[str, ...]]:
    """Encodings that write a word, by its bytes."""
    out: dict[bytes, tuple[str, ...]] = {}
    for meant in encodings():
        try:
            data = clean.encode(meant)
        except UnicodeError:
            continue
        out[data] = (*out.get(data, ()), meant)
    return out


def explanations(clean: str, seen: str) -> list[tuple[str, str, int]]:
    """Transformations that turn the clean text into the one seen, with the times they took place."""
    if len(_RUN.findall(clean)) != len(_RUN.findall(seen)) or clean == seen or clean.isascii():
        return []
    writings, out = _writings(clean), []
    for read in encodings():
        data = _bytes(seen, read)
        if data is None:
            continue
        out += [(meant, read, 1) for meant in writings.get(data, ()) if meant != read]
        before = seen
        for rounds in range(1, ROUNDS + 1):
            try:
                before = data.decode("utf-8")
            except UnicodeDecodeError:
                break
            if before == clean and rounds > 1:
                out.append(("utf_8", read, rounds))
            if before == clean or (data := _bytes(before, read)) is None:
                break
    return out


def _order(word: str, width: int = 1) -> str | None:
    """In which order pieces of a word repeat; None if they do not fill it."""
    if len(word) % width:
        return None
    pieces = [word[i : i + width] for i in range(0, len(word), width)]
    first = {p: i for i, p in reversed(list(enumerate(pieces)))}
    return ".".join([str(first[p]) for p in pieces])


def _unescaped(column: str):
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.col(column), r"\+", "%2B")), F.col(column))


def _words(df: DataFrame, fields: Sequence[str], urls: Sequence[str]) -> DataFrame:
    """Words with non-ASCII characters: ``n`` occurrences, and ``v`` different field values that hold them."""
    texts = F.array(*[_unescaped(f) if f in urls else F.col(f) for f in fields])
    values = df.select(F.explode(texts).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7f]")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    word = values.select("c", F.split("t", _SPLIT).alias("p")).select("c", "p", F.posexplode("p").alias("i", "w")).filter(F.col("w").rlike(r"[^\x00-\x7f]"))
    once = (F.array_position("p", F.col("w")) == F.col("i") + 1).cast("bigint")
    return word.groupBy("w").agg(F.sum("c").alias("n"), F.sum(once).alias("v"))


def twins(counted: DataFrame, clean_share: float = CLEAN_SHARE) -> DataFrame:
    """``clean`` and ``seen`` of every word and its possible twins."""
    code = F.ascii(F.regexp_extract("w", r"[^\x00-\x7f]", 0))
    script = F.when(code < 0x370, 0).when(code < 0x400, 1).when(code < 0x530, 2).otherwise(F.shiftright(code, 12) + 3)
    keyed = counted.select(F.regexp_replace("w", r"[^\x00-\x7f]+", "\x01").alias("k"), script.alias("s"), "w", "n", "v")
    # what is frequent in one script, or a hot value, leaves the other scripts' words twins
    totals = keyed.groupBy("k", "s").agg((F.sum("v") * clean_share).alias("least"))
    frequent = keyed.join(totals, ["k", "s"]).filter(F.col("v") >= F.col("least")).select("k", F.col("w").alias("clean"), F.col("n").alias("m"), F.col("v").alias("u"))
    fewer = (F.col("w") != F.col("clean")) & ((F.col("v") < F.col("u")) | ((F.col("v") == F.col("u")) & (F.col("n") < F.col("m"))))
    bare = F.col("k") == "\x01"
    framed = keyed.filter(~bare).join(frequent.filter(~bare), "k").filter(fewer)

    def ordered(rows: DataFrame, *widths: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(o, *r) for r in zip(*[c.to_pylist() for c in batch.columns]) for width in widths if (o := _order(r[0], width)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["o", "w", "n", "v"])

        return rows.mapInArrow(run, "o string, w string, n bigint, v bigint")

    # at most 1 / clean_share clean words a script
    clean = ordered(frequent.filter(bare & (F.length("clean") >= ORDERED)).select("clean", "m", "u"), 1).toDF("o", "clean", "m", "u")
    alike = ordered(keyed.filter(bare).select("w", "n", "v"), 1, 2, 3).join(F.broadcast(clean), "o").filter(fewer)
    return framed.select("clean", F.col("w").alias("seen")).unionByName(alike.select("clean", F.col("w").alias("seen")))


def learn_transformations(words: DataFrame, support: int = SUPPORT) -> list[tuple[str, str]]:
    """Learned ``(meant, read)``, best supported first."""

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(m, r) for m, r, _ in explanations(c, s)]
                common = [x for x in found if x in COMMON]
                out += [sorted({"\t".join(x) for x in common or found})] if found else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["found"])

    ensure_checkpoint(words.sparkSession)
    sets = twins(words).mapInArrow(explain, "found array<string>").groupBy("found").count().checkpoint()
    common = F.array(*[F.lit("\t".join(x)) for x in sorted(COMMON)])
    is_common = F.arrays_overlap("found", common)
    counted = sets.filter(is_common).select(F.explode("found").alias("x"), "count").groupBy("x").agg(F.sum("count").alias("c")).filter(F.col("c") >= support)
    learned = [tuple(r["x"].split("\t")) for r in counted.orderBy(F.desc("c"), "x").collect()]  # at most len(COMMON)
    rare = sets.filter(~is_common)
    while True:  # of all others the one that explains most pairs, then of the pairs left; at most a round each
        best = rare.select(F.explode("found").alias("x"), "count").groupBy("x").agg(F.sum("count").alias("c")).filter(F.col("c") >= support).orderBy(F.desc("c"), "x").head()
        if best is None:
            return learned
        learned.append(tuple(best["x"].split("\t")))
        rare = rare.filter(~F.array_contains("found", best["x"]))


class Restorer:
    """Words as they were meant: proved ones, and candidates that the corpus must prove."""

    def __init__(self, learned: Sequence[tuple[str, str]], letters: frozenset[str]) -> None:
        self.multi = [read for meant, read in learned if meant == "utf_8"]
        self.single = [(meant, read) for meant, read in learned if meant != "utf_8"]
        self.letters = letters | _MARKS | {"\u0307"}

    def _proved(self, part: str) -> str | None:
        """A part whose bytes are valid UTF-8 of letters."""
        for read in self.multi:
            out = restore(part, "utf_8", read)
            if out is not None and out != part and len(out) <= len(part) and (self._letters(out) or self._proved(out) is not None):
                return out
        return None

    def _letters(self, text: str, rare: bool = True) -> bool:
        """Letters of the corpus, or characters of three bytes and more: so long a valid sequence is no chance."""
        return all(c in self.letters or (c.isprintable() if c.isascii() else rare and c >= "\u0800" and unicodedata.category(c) in _GRAPHIC) for c in text.lower())

    def _partly(self, part: str) -> str | None:
        """A part of at least two valid sequences, and fewer bytes that have lost their neighbours."""
        for read in self.multi:
            data = _bytes(part, read)
            if data is not None:
                out = data.decode("utf-8", "replace")
                good = [c for c in out if not c.isascii() and c != LOST]
                if len(good) >= 2 and 0 < out.count(LOST) < len(good) and self._letters("".join(good), rare=False):
                    return out
        return None

    def _once(self, word: str) -> str | None:
        whole = self._proved(word)
        if whole is not None:
            return whole
        parts = _RUN.sub(lambda m: self._proved(m[0]) or m[0], word)
        if parts != word:
            return parts
        partly = _RUN.sub(lambda m: self._partly(m[0]) or m[0], word)
        if partly != word:
            return partly
        return None

    def proved(self, word: str) -> str | None:
        """The word that was meant as UTF-8, however often it was read wrongly."""
        out = None
        for _ in range(ROUNDS):
            current = self._once(word if out is None else out)
            if current is None or current == out:
                break
            out = current
            if out.isascii():
                break
        return out

    def candidates(self, word: str) -> list[str]:
        """What the word may be under the single-byte transformations: first what keeps capitals and small letters, then the best supported."""
        found = (restore(word, meant, read) for meant, read in self.single)
        outs = dict.fromkeys(out for out in found if out and out != word and not out.isascii())
        return sorted(outs, key=lambda out: sum(a.isupper() != b.isupper() for a, b in zip(word, out)))


def _letters_of(counts: DataFrame) -> frozenset[str]:
    """Other than ASCII letters of the words that can prove a repair."""
    own = counts.filter(F.col("n") >= KNOWN).select(F.explode(F.array_distinct(F.split("lo", ""))).alias("c")).distinct().filter(F.col("c").rlike(r"[^\x00-\x7f]"))
    return frozenset(r["c"] for r in own.collect())  # at most the characters of Unicode


def restored_words(words: DataFrame, learned: Sequence[tuple[str, str]]) -> DataFrame:
    """``w`` and ``out`` of every word that was read wrongly."""
    counts = words.groupBy(F.lower("w").alias("lo")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    restorer = words.sparkSession.sparkContext.broadcast((learned, _letters_of(counts)))
    arrow = pa.schema([("w", pa.string()), ("base", pa.string()), ("out", pa.string()), ("rank", pa.int32())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(*restorer.value)
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                meant = own.proved(w)
                if meant is not None:
                    rows.append((w, meant, None, 0))
                if meant is None or not meant.isascii():
                    base = meant or w
                    rows += [(w, base, out, i) for i, out in enumerate(own.candidates(base))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, arrow)], schema=arrow)

    found = words.select("w").mapInArrow(candidates, "w string, base string, out string, rank int").checkpoint()
    proved = found.filter("out IS NULL").select("w", "base")
    # a word that is garbled itself proves nothing
    clean = words.join(proved, "w", "left_anti").groupBy(F.lower("w").alias("lo")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).filter(F.col("n") >= KNOWN)
    tried = found.filter("out IS NOT NULL").withColumn("lo", F.lower("out")).join(clean, "lo").select("w", "base", "out", "rank", "n", "v")
    here = counts.select(F.col("lo").alias("lb"), F.col("n").alias("hn"), F.col("v").alias("hv"))
    tried = tried.withColumn("lb", F.lower("base")).join(here, "lb", "left")
    # by occurrences or by different values: rows of one hot value say nothing about a word
    better = (F.col("n") >= 3 * F.greatest(F.coalesce("hn", F.lit(0)), F.lit(1))) | (F.col("v") >= 3 * F.greatest(F.coalesce("hv", F.lit(0)), F.lit(1)))
    best = tried.filter(better).groupBy("w").agg(F.max_by("out", F.struct("n", "v", -F.col("rank"))).alias("single"))
    return proved.join(best, "w", "full").select("w", F.coalesce("single", "base").alias("out"))


class Repairer:
    """Repairs texts with what a lookup says of their words."""

    def __init__(self, lookup: Callable[[str], str | None]) -> None:
        self.lookup = lookup

    def text(self, text: str) -> tuple[bool, str]:
        """Whether the text is affected, and the text as meant."""
        if text.isascii():
            return False, text
        parts = _CUT.split(text)
        affected = LOST in text
        for i in range(0, len(parts), 2):
            if not parts[i].isascii():
                out = self.lookup(parts[i])
                if out is not None:
                    parts[i], affected = out, True
        return affected, "".join(parts)

    def url(self, url: str) -> tuple[bool, str]:
        """The same below percent-escapes, which stay escapes."""
        affected, out = self.text(url)
        if "%" not in out:
            return affected, out
        hit = False

        def below(m: re.Match) -> str:
            nonlocal hit
            try:
                text = unquote_to_bytes(m[0]).decode("utf-8")
            except UnicodeDecodeError:
                return m[0]
            bad, fixed = self.text(text)
            if not bad:
                return m[0]
            hit = True
            return quote(fixed, safe="")

        # an escaped word may hold plain letters between its escapes: repair it as one
        plain = re.compile(r"(?:[A-Za-z]|(?:%[0-9A-Fa-f]{2})+)+")

        def whole(m: re.Match) -> str:
            nonlocal hit
            if "%" not in m[0]:
                return m[0]
            try:
                text = unquote_to_bytes(m[0]).decode("utf-8")
            except UnicodeDecodeError:
                return _ESCAPES.sub(below, m[0])
            bad, fixed = self.text(text)
            if not bad:
                return m[0]
            hit = True
            return quote(fixed, safe="")

        out = plain.sub(whole, out)
        return affected or hit, out


def garbled_fields(df: DataFrame, key: str, fields: Sequence[str], urls: Sequence[str] = (), distinct: bool = True, sent_words: int = SENT_WORDS) -> DataFrame:
    """``key``, ``field``, ``stored``, ``repaired`` of every affected field."""
    spark = df.sparkSession
    ensure_checkpoint(spark)
    words = _words(df, fields, urls).checkpoint()
    meant = restored_words(words, learn_transformations(words)).checkpoint()
    arrow = pa.schema([("field", pa.string()), ("stored", pa.string()), ("repaired", pa.string())])
    id_type = df.select(key).schema[0].dataType.simpleString()
    # only fields that can be affected leave the JVM
    kept = [F.when(F.col(f).rlike(r"[^\x00-\x7f]" + ("|%" if f in urls else "")), F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = df.select(F.col(key).alias("k"), *kept).filter(F.coalesce(*[F.col(f"f{i}") for i in range(len(fields))]).isNotNull())

    if meant.count() <= sent_words:
        sent = spark.sparkContext.broadcast({r["w"]: r["out"] for r in meant.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repairer = Repairer(sent.value.get)
            for batch in batches:
                at, out = [], []
                for c, f in enumerate(fields, 1):
                    check = repairer.url if f in urls else repairer.text
                    for row, t in enumerate(batch.column(c).to_pylist()):
                        if t and (not t.isascii() or (f in urls and "%" in t)):
                            bad, fixed = check(t)
                            if bad:
                                at.append(row)
                                out.append((f, t, fixed))
                columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["k", *arrow.names])

        found = spread(rows).mapInArrow(run, f"k {id_type}, field string, stored string, repaired string")
    else:
        found = _joined(rows, meant, fields, urls)
    if distinct:
        found = found.groupBy("k", "field").agg(F.min(F.struct("stored", "repaired")).alias("v")).select("k", "field", "v.stored", "v.repaired")
    return found.withColumnRenamed("k", key)


def _joined(rows: DataFrame, meant: DataFrame, fields: Sequence[str], urls: Sequence[str]) -> DataFrame:
    """The same, each different value joined with its own words that were read wrongly."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("stored")) for i, f in enumerate(fields)])).alias("x")
    long = rows.select("k", each).select("k", "x.field", "x.stored").filter("stored <> ''")
    values = long.select("field", "stored").distinct()
    arrow = pa.schema([("field", pa.string()), ("stored", pa.string()), ("w", pa.string())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words: dict[str, None] = {}
                repairer = Repairer(lambda w, words=words: words.setdefault(w))
                bad, _ = (repairer.url if f in urls else repairer.text)(t)
                out += [(f, t, w) for w in words]
                out += [(f, t, None)] if bad else []  # characters were lost
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out) if out else [[]] * 3, arrow)], schema=arrow)

    wanted = values.mapInArrow(asked, "field string, stored string, w string")
    known = wanted.filter("w IS NOT NULL").join(meant, "w").select("field", "stored", "w", "out")
    lost = wanted.filter("w IS NULL").select("field", "stored", F.lit("").alias("w"), F.lit("").alias("out"))
    own = known.unionByName(lost).groupBy("field", "stored").agg(F.collect_list("w").alias("w"), F.collect_list("out").alias("out"))
    fixed_arrow = pa.schema([("field", pa.string()), ("stored", pa.string()), ("repaired", pa.string())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, t, w, meant_words in zip(*[c.to_pylist() for c in batch.columns]):
                repairer = Repairer(dict(zip(w, meant_words)).get)
                bad, fixed = (repairer.url if f in urls else repairer.text)(t)
                out += [(f, t, fixed)] if bad else []
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out) if out else [[]] * 3, fixed_arrow)], schema=fixed_arrow)

    fixed = own.mapInArrow(repair, "field string, stored string, repaired string")
    return long.join(fixed, ["field", "stored"]).select("k", "field", "stored", "repaired")
