"""Personal information in free text: bootstrapped contextual extraction.

Candidates are found by shape alone: words around an at sign, groups of digits, numbers beside street
words, sequences of capitalised words.  A candidate has an *instance* (the
shape of a number, the kind of street, the first word of a name) and *patterns*
(the words before it and after it).  A few seed instances of each type are
known.  Counts of (instance, pattern before, pattern after)
are a graph, on which Spark propagates scores: a mention's odds are the
prior odds times those of its parts over the prior, a part scores the mean of its
mentions, seeds stay fixed.  After ``ROUNDS`` rounds contexts that surround seeds have high scores,
and so do instances never seeded that stand in them.  The scored parts then
decide every candidate of every text, also a full name whose first word was never
seen; within a text, a surname that a full or
titled name has introduced is found again where it stands alone.

Every text is read whole, and once: the table of all candidates with their patterns,
written to the shared checkpoint folder beside the texts, gives the counts that are
scored and, in a second step, the mentions that the scores decide.

Parts are kept if they make up at least ``SHARE`` of the mentions of their
class, so at most ``1 / SHARE`` instances and twice as many patterns a class
reach the driver and the executors, at any corpus size; a candidate with a rarer
part is decided by its other parts.

Defined results
* Null, empty and blank texts hold nothing, their redacted text is unchanged.
* Values are cut from the text as written; runs of white space become a space.
* A candidate that touches masked characters is no case; neither are bare
  initials, numbers of cases, files and invoices, streets without a number,
  and names inside organisations.
* Overlaps: an earlier, then a longer finding wins.  Every row is searched by
  itself, so repeated rows repeat their cases.  Whole texts are read; empty tables give no rows.
"""

from __future__ import annotations

import gc
import marshal
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir, ensure_checkpoint, spread

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
ROUNDS = 4
SHARE = 2e-5
ACCEPT = 0.5
PRIOR = 0.15
#: A first word is seeded as a given name, or as none, by the share of its mentions whose last word is introduced.
GIVEN_YES, GIVEN_NO = 0.3, 0.05
#: Columns of the candidates' class and of the question asked of it.
QUESTIONS = {"email": ("email",), "number": ("phone", "id_number"), "street": ("street_address",), "name": ("person_name",)}

#: Seed instances (1: of the type, 0: of none).  Numbers by shape, # a digit and A a letter.
SEEDS: dict[str, dict[str, float]] = {
    "email": {"a@a": 1, "a [at] a [dot] a": 1},
    "phone": {
        "+## #### ######": 1, "+## ## ##### ###": 1, "+# ###-###-####": 1, "+## # ## ## ## ##": 1, "(###) ###-####": 1,
        "AA ## ## ## A": 0, "AA######A": 0, "# ## ## ## ### ### ##": 0, "## ### ### ###": 0,
        "####-AA-#######": 0, "AA-####-###": 0, "A-####-#####": 0, "##/####/####": 0, "####-##-##": 0, "##.##.####": 0, "##/##/####": 0,
        "#####/###/####": 0, "## A ######/##": 0, "# A ######/##": 0, "##/#######": 0, "###.###": 0, "### ###": 0,
    },
    "id_number": {
        "AA ## ## ## A": 1, "AA######A": 1, "# ## ## ## ### ### ##": 1, "## ### ### ###": 1,
        "+## #### ######": 0, "+## ## ##### ###": 0, "+# ###-###-####": 0, "+## # ## ## ## ##": 0, "(###) ###-####": 0,
        "####-AA-#######": 0, "AA-####-###": 0, "A-####-#####": 0, "##/####/####": 0, "####-##-##": 0, "##.##.####": 0, "##/##/####": 0,
        "#####/###/####": 0, "## A ######/##": 0, "# A ######/##": 0, "##/#######": 0, "###.###": 0, "### ###": 0,
    },
    # kinds of street; of German names the last four letters
    "street_address": {"road": 1, "street": 1, "raße": 1, "rue": 1, "avenue": 1, **{m: 0 for m in (
        "january february march april may june july august september october november december janvier février mars avril juin juillet août septembre octobre novembre décembre "
        "uary arch pril june july gust mber ober nuar ruar märz juni juli band teil satz blatt nummer act norh civ eite page").split()}},
    "person_name": {},
}
#: Seeds that are never of a type.
_NEVER_NUMBER = frozenset(i for i, s in SEEDS["phone"].items() if s == 0 and SEEDS["id_number"].get(i) == 0)
_NEVER_STREET = frozenset(i for i, s in SEEDS["street_address"].items() if s == 0)
#: Titles that introduce a natural person, and words that end an organisation's name.
TITLES = frozenset("Mr Mrs Ms Miss Dr Sir Lord Lady Justice Judge Master Prof Professor Herr Frau Herrn Mme Mlle Me Maître Monsieur Madame Richter Richterin Vorsitzende Vorsitzender Zeuge Zeugin Président Greffier Rapporteur".split())
COMPANY = r"(?:Ltd|Limited|plc|PLC|LLP|Inc|Corp|GmbH|AG|KG|SARL|SAS|SA|SE|OHG|mbH|Ltd\.)"


class Memo(dict):
    """Values of a pure function of short strings, a bounded number of them."""

    def __init__(self, f: Callable[[str], object], most: int = 1 << 17) -> None:
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.f(key)
        return out


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    """One spelling for letters that scanners confuse."""
    word = unicodedata.normalize("NFC", word).lower().replace("ı", "i").replace("rn", "m").replace("ii", "u").replace("li", "h")
    return word.replace("c", "e").replace("1", "l").replace("0", "o")


_TITLES = frozenset(map(fold, TITLES))


#: Whether a word is a title.
_TITLE = Memo(lambda token: fold(token.rstrip(".")) in _TITLES)


_UP = "A-ZÀ-ÖØ-ÞŁŚŻŽŠİ"
_GAP = r"(?:[ \t\xa0\u2009\u202f]++(?:\r\n|\r|\n)?+[ \t\xa0]*+|(?:\r\n|\r|\n)[ \t\xa0]*+)"
#: A letter or digit, or a combining mark of a decomposed one.
_W = "[\\w\u0300-\u036f]"
_WS, _WP = (rf"\w{n}+(?:[\u0300-\u036f]++\w*+)*+" for n in "*+")
_WORD = rf"[{_UP}]{_WS}(?:['’](?!s\b){_WP})?(?:[-‐](?:(?:\r\n|\r|\n)[ \t]*)?{_WP})*"
_INITIAL = rf"[{_UP}]\.(?:-?[{_UP}]\.)*"
_PARTICLE = r"(?:(?:von|Von|VON)(?:[ ](?:der|dem|den|DER|DEM|DEN))?|zu|Zu|ZU|van(?:[ ](?:der|den))?|(?:de|De|DE)(?:[ ](?:la|La|LA))?|du|Du|DU|le|Le|LE|la|La|LA|der|ten|Mac|O['’])"
_SURNAME = rf"(?:{_PARTICLE}{_GAP})?(?:[dDlL]['’])?{_WORD}"
_COMPANY_END = re.compile(rf"\s{COMPANY}(?!\w)")
_TO_COMPANY = re.compile(rf"(?:{_GAP}[{_UP}](?:{_W}|['’&-])*){{0,2}}?{_GAP}{COMPANY}(?!\w)")
_IS_PARTICLE = re.compile(r"von|Von|VON|zu|Zu|ZU|van|de|De|DE|du|Du|DU|le|Le|LE|la|La|LA|der|dem|den|DER|DEM|DEN|ten|Mac|[dDlLO]['’]")
_IS_INITIAL = re.compile(_INITIAL)
_COMMA_GIVEN = re.compile(rf",{_GAP}({_WORD})")
_MORE_NAME = re.compile(rf"{_GAP}(?:{_INITIAL}{_GAP})?{_SURNAME}")
_LEADING = re.compile(rf"(?:{_PARTICLE}{_GAP}|\b[dDlL]['’])$")
_LEADING_CAPS = re.compile(rf"\b(?:VON|VON[ ]DE[RMN]|ZU|DE|DE[ ]LA|DU|LE|LA){_GAP}$")
_CAPITAL_WORD = re.compile(rf"[{_UP}](?:\.(?:-?[{_UP}]\.)*(?!\w)|(?:['’](?=[{_UP}]))?{_WS}(?:['’](?!s\b){_WP})?(?:[-‐](?:(?:\r\n|\r|\n)[ \t]*)?{_WP})*)")
_LAST = rf"(?P<last>(?:{_PARTICLE}{_GAP})?(?:[dDlLO]['’])?(?P<word>{_WORD})(?!\.?\w))"
_AFTER_GIVEN = re.compile(rf"(?:{_GAP}{_INITIAL})*{_GAP}{_LAST}")
#: Where more of a name can begin: white space, a capital, or a small particle and what must follow it.
_ON = rf"(?:[\s{_UP}]|[dl]['’]|(?:von|van|zu|de|du|le|la|der|ten)\s)"
#: A capitalised word that a name, or more of one, may follow.
_NAME_PART = re.compile(rf"{_CAPITAL_WORD.pattern}(?=\.?\s{_ON}|,)")
_AFTER_TITLE = re.compile(rf"\.?{_GAP}(?P<name>{_LAST})")
#: Whether a name can go on with these two characters: white space, then more of it, a capital or a particle.
_GOES_ON = Memo(re.compile(rf"\s[\s{_UP}vzdlt]").match)


def in_company(text: str, start: int, end: int) -> bool:
    """Whether the span is among the last three capitalised words of a company's name."""
    if _GOES_ON[text[end : end + 2]] is not None and _TO_COMPANY.match(text, end) is not None:
        return True
    return _COMPANY_END.search(text, start - 1 if start else 0, end) is not None


_SEP = r"(?:[ \xa0\u2009\u202f]|\r?\n|[-./‐‑–]|\)(?:[ \xa0]|\r?\n)?|(?:[ \xa0]|\r?\n)?\((?=\d))"
#: Fixed value: labels and units that a number's letters are not.
_LABEL = "(?!(?:NIR|SSN|ID|NINO|CNI|EUR|USD|GBP|RG|NHC|NHCA|NHGZ|OLG|BGH|ZR)\\b)"
#: The start of a number, if five digits follow with no more than three other characters between two.
_START = re.compile(r"[+(\dA-Z][\dA-Z(]*+(?:(?<=\d)|(?<=\d[A-Z])|(?=\D{0,7}\d))")
NUMBER = re.compile(rf"[+(]{{0,2}}{_LABEL}(?:[A-Z]{{1,5}}(?:[ \xa0-]|\r?\n)?(?=[\dA-Z]*\d))?\d[\dA-Z]*+(?:{_SEP}(?:[A-Z]*+\d[\dA-Z]*+|[A-Z](?![\w]))\b){{0,10}}")
_GROUPS = re.compile(r"[+(]*[\dA-Z]+\)?")
EXTENSION = re.compile(r"(?:[ \xa0,]|\r?\n)*(?:x|ext\.?|extension|Durchwahl|DW|poste|App\.)[ \xa0]?\d{1,6}\b")
_AT = re.compile(r"[@\[({<](?:(?<=@)|\s*[aA][tT]\s*[\])}>])")
_LOCAL = re.compile(r"(?<![\w.+*•█-])\w[\w.+-]*+\s*$")
_DOMAIN = re.compile(r"\s*[\w-]+(?:(?:\.|\s*[\[({<]\s*(?:dot|punkt|point)\s*[\])}>]\s*)[\w-]+)+(?<!-)", re.I)


def emails(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    """Mailboxes, from their at sign, also spelt out in brackets, at one of ``signs``."""
    for at in signs:
        if (m := _AT.match(text, at)) is None:
            continue
        low = max(0, m.start() - 90)
        plain = m.group() == "@"
        domain = _DOMAIN.match(text, m.end())
        if domain is None or not (words := text[low : m.start()].rsplit(None, 1)):
            continue
        low = text.rindex(words[-1], low, m.start())  # nothing before the last word belongs to it
        local = _LOCAL.search(text[low : m.start()])
        if local and not (plain and local.group()[-1:].isspace() != domain.group()[:1].isspace()):
            yield low + local.start(), domain.end()


_MAILBOX_WORD = re.compile(r"(?<![\[({<\w])(?:[\w+-]|\.(?=\w))+(?![\])}>])")


_BRACKETS = str.maketrans("({<)}>", "[[[]]]")


def mailbox_form(value: str) -> str:
    """How a mailbox is spelt: words as a, all brackets alike, signs and what brackets hold as they are."""
    return _MAILBOX_WORD.sub("a", _SPACE.sub(" ", value.lower())).translate(_BRACKETS)


_STREET_FROM = re.compile(
    rf"\d(?<!\d\d)\d{{0,3}}+(?=[a-zA-Z,\s])[a-zA-Z]?(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}(?![a-z]{{1,10}}[ ](?!d))"
    rf"(?:(?P<en>(?:[{_UP}][\w'’]*+{_GAP}){{1,3}}?(?P<kind>[{_UP}][a-z]++)\b(?P<dot>\.(?=[\s,;]))?(?!{_GAP}(?:Hill|Mill|Lane|Road|Rd|Street|St|Close|Court|Terrace|Way|Ave)\b)(?:,{_GAP}(?:Flat|Unit|Apt\.?|Apartment|Suite){_GAP}\w{{1,4}}\b)?)"
    rf"|(?P<fr>[a-zéè]{{2,10}}+\.?){_GAP}(?:de{_GAP}la{_GAP}|de{_GAP}l['’]|des{_GAP}|du{_GAP}|de{_GAP}|d['’])[{_UP}](?:{_W}|['’-])*(?:{_GAP}[{_UP}](?:{_W}|['’-])*)?)"
)
_FLAT = re.compile(rf"(?:Flat|Unit|Apt\.?|Apartment|Suite|Appt\.?|Bât\.?){_GAP}\w{{1,4}},?{_GAP}$")
_HOUSE = re.compile(r"\d{1,4}(?:[ ]?[a-z](?!\w))?(?:/\d{1,4})?(?![\w./-]*\d)")
_STREET_TO = re.compile(rf"(?:(?:Alte[rns]?|Neue[rns]?|Am|An|Große[rs]?|Kleine[rs]?|Obere[rs]?|Untere[rs]?){_GAP}(?:der{_GAP}|den{_GAP})?)?[{_UP}][a-zäöüß\u0300-\u036f-]*(?P<de>str\.|[a-zß]{{4}}){_GAP}$")
_PARAGRAPH = re.compile(rf"[.)]?[ \t]+[{_UP}]")


#: Whether the piece of text before a house number can be a street of the kind that ends in its last four letters.
_STREETY = Memo(re.compile(rf"[{_UP}][a-zäöüß\u0300-\u036f-]*(?:str\.|[a-zß]{{4}})\s*$").search)


def streets(text: str, fronts: list[int], behind: list[int]) -> Iterator[tuple[str, int, int]]:
    """Kind and offsets of numbers beside street-like words, in front of one or behind it."""
    past = 0
    for at in fronts:
        if at < past or (m := _STREET_FROM.match(text, at)) is None:
            continue
        past = m.end()
        if at and not (text[at - 1] in "/.,-" or text[at - 1].isalnum()):
            flat = _FLAT.search(text[max(0, at - 20) : at])
            kind = m["kind"] + (m["dot"] or "") if m["en"] else m["fr"]
            yield kind.lower(), at - (len(flat.group()) if flat else 0), m.end()
    for at in behind:
        low = max(0, at - 48)
        if not _STREETY[text[text.rfind(" ", low, at - 1) + 1 or low : at - 1]] or (m := _HOUSE.match(text, at)) is None:
            continue
        street = _STREET_TO.search(text[low:at])
        if street and not (_BREAK.search(text, at - 2, at) and _PARAGRAPH.match(text, m.end())):
            yield street["de"], low + street.start(), m.end()


_MASK = re.compile(r"[•*█▇■]|X{3}")
_CONTEXT = re.compile(r"\w+|[^\w\s]")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_ELISION = re.compile(r"^[dDlL]['’]")
_BREAK = re.compile(r"[\r\n]")
_FRENCH = re.compile(r"\b(?:le|la|les|du|est)\b")


_FORM = {ord(c): o for o, cs in (("#", "0123456789"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("-", "‐‑–"), (" ", "\t\n\r\f\v\xa0\u2009\u202f")) for c in cs}


def shape(value: str) -> str:
    """Digits as #, capitals as A, white space as one space, all dashes alike."""
    form = value.translate(_FORM)
    return _SPACE.sub(" ", form) if "  " in form else form


_THIN = frozenset(("number", "nummer", "numéro"))


def _pattern(tokens: list[str]) -> str:
    out = " ".join(tokens)
    return out if out.replace(" ", "").isalpha() else _DIGITS.sub("#", out)


def _enough(piece: str) -> str | None:
    """The last word with its punctuation, None if it takes the word before to say anything."""
    tokens = _CONTEXT.findall(piece.lower())
    for at in range(len(tokens) - 1, -1, -1):
        if tokens[at][0].isalnum():
            return _pattern(tokens[at:]) if len(tokens[at]) > 2 and tokens[at] not in _THIN else None
    return None


def _two_words(pieces: str) -> str:
    tokens = _CONTEXT.findall(pieces.lower())
    at = len(tokens)
    for _ in range(2):
        at -= 1
        while at > 0 and not tokens[at][0].isalnum():
            at -= 1
        if at <= 0 or len(tokens[at]) > 2 and tokens[at] not in _THIN:
            break
    return _pattern(tokens[max(0, at) :])


def _two_tokens(piece: str) -> str | None:
    tokens = _CONTEXT.findall(piece.lower())
    return _pattern(tokens[:2]) if len(tokens) > 1 else None


_BEFORE_ONE, _BEFORE_TWO = Memo(_enough), Memo(_two_words)
_AFTER_ONE, _AFTER_TWO = Memo(_two_tokens), Memo(lambda pieces: _pattern(_CONTEXT.findall(pieces.lower())[:2]))


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The last word before with its punctuation (two words if it is short), and two tokens after; digits as #, lower case.

    At most two pieces between spaces count on either side, within 36 and 32 characters.
    """
    low, high = start - 36 if start > 36 else 0, end + 32
    at = text.rfind(" ", low, start - 1 if start else 0) + 1 or low
    before = _BEFORE_ONE[text[at:start]]
    if before is None:
        if start - at < 3 and not text[at:start].strip().isalnum():
            at = low  # a piece of marks alone, as of a page number, is passed over
        before = _BEFORE_TWO[text[text.rfind(" ", low, at - 1 if at else 0) + 1 or low : start]]
    at = text.find(" ", end + 1, high)
    if at < 0:
        return before, _AFTER_TWO[text[end:high]]
    after = _AFTER_ONE[text[end:at]]
    if after is None:
        at = text.find(" ", at + 1, high)
        after = _AFTER_TWO[text[end : at if at >= 0 else high]]
    return before, after


def candidates(text: str, clusters: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Numbers of five digits or more and their shapes; an opening bracket belongs to one only if it closes inside."""
    past = 0
    for low, high in clusters:
        if high <= past:
            continue
        # letters, signs and brackets may stand before the first digit, but not before a plain word and a space
        at = low if low - 1 > past and text[low - 1] == " " and text[low - 2].islower() else max(past, low - 10)
        while at < high and (first := _START.search(text, at, high)):
            start = at = first.start()
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@•*█.") or (m := NUMBER.match(text, start)) is None:
                at = first.end()
                continue
            past = at = end = m.end()
            if end - start >= 5:
                form = shape(m.group())
                if form.count("#") >= 5:
                    cut = form[0] == "(" and form.count("(") > form.count(")")
                    yield start + cut, end, form[cut:]


def has_masks(text: str) -> bool:
    """Whether any characters of the text are masked."""
    return "•" in text or "*" in text or "XXX" in text or "█" in text or "▇" in text or "■" in text


def _masked(text: str, start: int, end: int) -> bool:
    return bool(_MASK.search(text[max(0, start - 3) : end + 3]))


#: The given name of a name's first word.
_GIVEN = Memo(lambda token: unicodedata.normalize("NFC", token.split("-")[0]).capitalize())


#: A surname without spaces, in small letters.
_SURNAME_KEY = Memo(lambda part: "".join(part.split()).lower())


def _marked(text: str, spans: list[tuple[int, int]]) -> bytearray:
    """Ones where a span covers the text."""
    out = bytearray(len(text))
    for a, b in spans:
        out[a:b] = b"\1" * (b - a)
    return out


#: The rest of a name: its end, the start of its last part with particles, and the span of its last word.
Rest = tuple[int, int, int, int]


def _rest(text: str, at: int, pattern: re.Pattern = _AFTER_GIVEN) -> Rest | None:
    """What of a name follows a word that ends at ``at``."""
    m = pattern.match(text, at)
    if m is None:
        return None
    spans = m.regs  # the last two groups are the last part and its word
    return (spans[0][1], spans[-2][0], *spans[-1])


@dataclass
class Scan:
    """All candidates of a text with their patterns: offsets, instance, pattern before, pattern after.

    Of ``words``, those that a name may follow, the patterns are those of word and
    rest together, where the rest was looked for.
    """

    mails: list[tuple[int, int, str, str, str]]
    numbers: list[tuple[int, int, str, str, str]]
    streets: list[tuple[int, int, str, str, str]]
    words: list[tuple[int, int] | tuple[int, int, Rest, str, str]]
    counted: list[tuple[str, str, str, str]]

    def packed(self) -> bytes:
        """What deciding takes."""
        numbers = [x for x in self.numbers if x[2] not in _NEVER_NUMBER]
        return marshal.dumps((self.mails, numbers, [x for x in self.streets if x[2] not in _NEVER_STREET], self.words))

    @classmethod
    def unpacked(cls, data: bytes) -> Scan:
        return cls(*marshal.loads(data), [])


_BIT_PATTERNS = (r"\d+", r"\w+", r"\s+", f"[{_UP}]+", "[a-zß]+", "[A-Za-z]+", "[.'’‐\u0300-\u036f-]", "[vzdlt]", r"[@\[({<]", "_")
_DIGIT_BIT, _WORD_BIT, _SPACE_BIT, _UP_BIT, _SMALL_BIT, _LETTER_BIT, _JOIN_BIT, _LEAD_BIT, _SIGN_BIT, _UNDER_BIT = (np.uint16(1 << i) for i in range(10))
#: Characters between two texts that are read together, more than any look to a side takes.
_APART = 8
#: Characters that are read together.
_TOGETHER = 1 << 17


@lru_cache(maxsize=1)
def _bits() -> np.ndarray:
    """For each character, a bit for each of the patterns that take it."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint16)
    for i, pattern in enumerate(_BIT_PATTERNS):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] |= 1 << i
    return out


@dataclass
class Spots:
    """Where candidates of a text can begin."""

    #: at signs and brackets that may hold one
    signs: list[int]
    #: spans of five digits or more, no more than three other characters between two
    clusters: list[tuple[int, int]]
    #: numbers of up to four digits before a word, and those behind one that may end a street's name
    fronts: list[int]
    behind: list[int]
    #: words for ``_NAME_PART``, and where they end, -1 if only the pattern tells
    words: list[tuple[int, int]]


def spots(texts: list[str]) -> list[Spots]:
    """The spots of each text, found in all texts at once."""
    apart = "\0" * _APART
    cp = np.frombuffer(f"{apart}{apart.join(texts)}{apart}".encode("utf-32-le", "surrogatepass"), "<u4")
    f = _bits().take(cp)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + _APART
    starts = np.cumsum(lengths) - lengths + _APART

    def own(at: np.ndarray, *more: np.ndarray) -> list[list]:
        """Of offsets, and of values beside them, those of each text."""
        cuts = np.searchsorted(at, starts).tolist() + [len(at)]
        shift = np.repeat(starts, np.diff(cuts))
        values = (at - shift).tolist() if not more else [*zip((at - shift).tolist(), *[np.where(x < 0, x, x - shift).tolist() for x in more])]
        return [values[a:b] for a, b in zip(cuts, cuts[1:])]

    stops = np.flatnonzero(f & _WORD_BIT == 0)
    # signs
    at = stops[f[stops] & _SIGN_BIT != 0]
    then = cp[at + 1]
    signs = at[(cp[at] == 64) | (then == 97) | (then == 65) | (f[at + 1] & _SPACE_BIT > 0)]
    # numbers
    digits = np.flatnonzero(f & _DIGIT_BIT != 0)
    step = np.diff(digits, prepend=-9)
    cut = np.flatnonzero(step > 4)
    ends = np.append(cut[1:], len(digits)) if len(cut) else cut
    long = ends - cut >= 5
    low, high = digits[cut[long]], digits[ends[long] - 1] + 1
    cut = np.flatnonzero(step > 1)
    ends = np.append(cut[1:], len(digits)) if len(cut) else cut
    few = ends - cut <= 4
    first, end = digits[cut[few]], digits[ends[few] - 1] + 1
    one, two = f[end], f[end + 1]
    stop = stops.take(np.searchsorted(stops, end + 1), mode="clip")
    then, third = cp[stop], f[np.minimum(stop + 1, len(f) - 1)]
    on = (then != 32) | (third & _SPACE_BIT > 0)  # else a capitalised word or a small one behind the first space decides
    capital = (two & _UP_BIT > 0) & (on | (third & _UP_BIT > 0))
    small = (two & (_UP_BIT | _DIGIT_BIT) == 0) & (two & _WORD_BIT > 0)
    small &= on | (third & _LEAD_BIT > 0) | (cp[end + 1] == 98) | (cp[end + 1] == 116) | (cp[end + 1] == 113)
    spaced = (one & _SPACE_BIT > 0) & ((two & _SPACE_BIT > 0) | capital | small)
    tight = ((one & _LETTER_BIT > 0) | (cp[end] == 44)) & ((two & _SPACE_BIT > 0) | (cp[end + 1] == 44))
    gap, last = cp[first - 1], cp[first - 2]
    small = f[first - 2] & f[first - 3] & f[first - 4] & f[first - 5] & _SMALL_BIT > 0
    short = (last == 46) & (cp[first - 3] == 114) & (cp[first - 4] == 116) & (cp[first - 5] == 115)
    behind = first[((gap == 32) | (gap == 10) | (gap == 160)) & (small | short | (last == 13))]
    # capitals
    caps = np.flatnonzero(f & _UP_BIT != 0)
    begin = stops[np.searchsorted(stops, behind - 2) - 1] + 1
    named = np.searchsorted(caps, begin) < np.searchsorted(caps, behind)
    behind = behind[named | (f[begin - 1] & _JOIN_BIT > 0) | (f[behind - 2] & _WORD_BIT == 0)]
    i = np.searchsorted(stops, caps)
    stop, begin = stops[i], stops[i - 1] + 1
    dot, alone = cp[stop] == 46, stop == caps + 1
    after = stop + dot  # a point may stand before the space, and belongs to a single capital
    join = (f[stop] & _JOIN_BIT > 0) & (~dot | alone & (f[after] & _SPACE_BIT == 0))
    goes = f[after] & _SPACE_BIT > 0
    lead = goes & (f[after + 1] & _LEAD_BIT > 0)
    keep = join | lead | (cp[stop] == 44) | goes & (f[after + 1] & (_SPACE_BIT | _UP_BIT) > 0)
    # inside a word that begins with a capital, nothing begins that the word's own start does not take or refuse alike
    inner = (f[caps - 1] & _WORD_BIT > 0) & (cp[caps - 1] != 95)
    alike = inner & ~((join | dot) & (alone | (f[begin] & _UP_BIT == 0)))
    under = np.flatnonzero(f & _UNDER_BIT != 0)
    if len(under):
        alike &= np.searchsorted(under, begin) == np.searchsorted(under, stop)
    keep &= ~alike
    return [*map(Spots, own(signs), own(low, high), own(first[spaced | tight]), own(behind), own(caps[keep], np.where(join | lead, -1, stop + (dot & alone))[keep]))]


def scan(text: str) -> Scan:
    """Reads a text once, for counting its candidates and for deciding them."""
    return _scan(text, spots([text])[0])


def scans(texts: list[str]) -> Iterator[Scan]:
    """The same of many texts."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and size < _TOGETHER:
            size += len(texts[at])
            at += 1
        yield from map(_scan, texts[first:at], spots(texts[first:at]))


def _scan(text: str, spots: Spots) -> Scan:
    mails = [(a, b, mailbox_form(text[a:b]), *context(text, a, b)) for a, b in emails(text, spots.signs)]
    numbers = [(a, b, form, *context(text, a, b)) for a, b, form in candidates(text, spots.clusters)]
    roads = [(a, b, kind, *context(text, a, b)) for kind, a, b in streets(text, spots.fronts, spots.behind)]
    counted = [("email", *x[2:]) for x in mails]
    if has_masks(text):
        counted += [("number", *x[2:]) for x in numbers if not _masked(text, x[0], x[1])]
    else:
        counted += [("number", *x[2:]) for x in numbers]
    counted += [("street", *x[2:]) for x in roads]
    words: list = []
    pairs, introduced, past, taken = [], set(), 0, 0
    for span in spots.words:
        start, end = span
        if start < taken:
            continue
        if end < 0:
            m = _NAME_PART.match(text, start)
            if m is None:
                continue
            start, end = span = m.span()
        taken = end
        if start and text[start - 1].isalnum():
            continue
        if start < past or text[end] == ",":
            words.append(span)
            continue
        word = text[start:end]
        rest, before, after = None, "", ""
        if word[-1] == ".":
            if rest := _rest(text, end):
                introduced.add(text[rest[2] : rest[3]].lower())
                past = rest[0]
        elif _TITLE[word]:
            last = _rest(text, end, _AFTER_TITLE)
            if last is not None and not _TITLE[text[last[2] : last[3]]]:
                if more := _rest(text, last[0]):
                    pairs.append((_GIVEN[text[last[2] : last[3]]], text[more[2] : more[3]].lower(), False, True, context(text, start, more[0])))
                    last = more
                past = last[0]
                introduced.add(text[last[2] : last[3]].lower())
        elif end - start > 2 and not word.isupper() and (m := _AFTER_GIVEN.match(text, end)):
            spans = m.regs  # as in _rest
            past = spans[0][1]
            low, high = spans[-1]
            rest = (past, spans[-2][0], low, high)
            before, after = patterns = context(text, start, past)
            pairs.append((_GIVEN[word], text[low:high].lower(), in_company(text, start, past), False, patterns))
        else:
            continue  # no part of a name that is decided
        words.append(span if rest is None else (start, end, rest, before, after))
    for given, surname, inside, skip, (before, after) in pairs:
        # the pair's last word also stands behind a title or an initial: the first one is a given name
        mark = "org" if inside else "yes" if skip or surname in introduced else "no"
        counted.append(("name", f"{mark} {given}", "title" if skip else before, after))
    return Scan(mails, numbers, roads, words, counted)


def _logit(p: float) -> float:
    p = min(max(p, 0.01), 0.99)
    return math.log(p / (1 - p))


@dataclass
class Knowledge:
    """Scores of instances and patterns, by question."""

    instance: dict[str, dict[str, float]] = field(default_factory=dict)
    before: dict[str, dict[str, float]] = field(default_factory=dict)
    after: dict[str, dict[str, float]] = field(default_factory=dict)

    def evidence(self) -> Knowledge:
        """The same, as log-odds over the prior."""
        base = _logit(PRIOR)
        return Knowledge(*[{q: {v: _logit(x) - base for v, x in own.items()} for q, own in t.items()} for t in (self.instance, self.before, self.after)])


_COUNTS = "cls string, i string, l string, r string, n bigint"
_COUNTED = pa.schema([("cls", pa.string()), ("i", pa.string()), ("l", pa.string()), ("r", pa.string()), ("n", pa.int64())])


def _texts(df: DataFrame, key: str | None, text: str) -> DataFrame:
    return spread(df.select((F.lit(None) if key is None else F.col(key)).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")))


def _scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """The table of one reading of all texts: rows with a text and its scan, and rows with counts of candidates."""
    arrow = pa.schema([("k", pa.int64()), ("t", pa.string()), ("scan", pa.binary()), *_COUNTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic
        for batch in batches:
            seen: Counter = Counter()
            texts = batch.column(1).to_pylist()
            own: list[bytes | None] = [None] * len(texts)
            held = [i for i, t in enumerate(texts) if t and not t.isspace()]
            for i, found in zip(held, scans([texts[i] for i in held])):
                seen.update(found.counted)
                own[i] = found.packed()
            nulls = [pa.nulls(batch.num_rows, f.type) for f in _COUNTED]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(own, pa.binary()), *nulls], schema=arrow)
            if seen:
                columns = [pa.array(c, f.type) for c, f in zip([*zip(*seen), tuple(seen.values())], _COUNTED)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(seen), f.type) for f in list(arrow)[:3]), *columns], schema=arrow)

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/scanned-{uuid.uuid4().hex}"
    _texts(df, key, text).mapInArrow(run, f"k bigint, t string, scan binary, {_COUNTS}").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def learn(df: DataFrame, text: str, rounds: int = ROUNDS, share: float = SHARE) -> Knowledge:
    """Scores, from the counts of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for found in scans([t for t in batch.column(1).to_pylist() if t]):
                seen.update(found.counted)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*seen), tuple(seen.values())], _COUNTED)], schema=_COUNTED)

    return _learned(_texts(df, None, text).filter(F.col("t") != "").mapInArrow(count, _COUNTS), rounds, share)


def _learned(counted: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> Knowledge:
    """Scores, from counts of instances and patterns."""
    spark = counted.sparkSession
    ensure_checkpoint(spark)
    combos = counted.groupBy("cls", "i", "l", "r").agg(F.sum("n").alias("n")).checkpoint()
    totals = combos.groupBy("cls").agg(F.sum("n").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("v")) for p in "ilr"])).alias("x")

    def part(scores: DataFrame, p: str, *names: str) -> DataFrame:
        return F.broadcast(scores.filter(F.col("p") == p).drop("p").toDF(*names))

    # frequent parts only; the rest of the candidates keep a null there
    sums = combos.select("cls", "n", each).filter("x.v <> ''").groupBy("cls", "x.p", "x.v").agg(F.sum("n").alias("s"))
    kept = sums.join(F.broadcast(totals), "cls").filter((F.col("s") >= F.col("total") * share) & (F.col("s") >= 2)).select("cls", "p", "v", F.lit(True).alias("has")).checkpoint()
    graph = combos
    for p in "ilr":
        graph = graph.join(part(kept, p, "cls", p, "has"), ["cls", p], "left").withColumn(p, F.when(F.col("has"), F.col(p))).drop("has")
    question = F.explode(F.create_map(*[x for c, q in QUESTIONS.items() for x in (F.lit(c), F.array(*map(F.lit, q)))])[F.col("cls")])
    seeds = spark.createDataFrame([(q, i, float(s)) for q, own in SEEDS.items() for i, s in own.items()], "q string, i string, seed double")
    # given names are seeded by how often their mention's last word is introduced as a surname in the same text
    bare = F.regexp_replace("i", "^(?:yes|no|org) ", "")
    share_yes = F.sum(F.when(F.col("i").startswith("yes "), F.col("n")).otherwise(0)) / F.sum("n")
    lexical = combos.filter("cls = 'name'").groupBy(bare.alias("i")).agg(share_yes.alias("yes"), F.sum("n").alias("n")).filter((F.col("yes") >= GIVEN_YES) | (F.col("yes") <= GIVEN_NO))
    names = combos.filter("cls = 'name'").agg(F.sum("n")).scalar()
    seeds = seeds.unionByName(lexical.filter(F.col("n") >= names * share).select(F.lit("person_name").alias("q"), "i", (F.col("yes") >= GIVEN_YES).cast("double").alias("seed")))
    named = F.when(F.col("cls") == "name", bare).otherwise(F.col("i"))
    graph = graph.withColumn("i", named).groupBy("cls", "i", "l", "r").agg(F.sum("n").alias("n")).select("*", question.alias("q")).drop("cls")
    graph = graph.join(F.broadcast(seeds), ["q", "i"], "left").checkpoint()
    scored = None
    for _ in range(rounds):
        step = graph
        for p in "ilr":
            step = step.withColumn(f"s_{p}", F.lit(None).cast("double")) if scored is None else step.join(part(scored, p, "q", p, f"s_{p}"), ["q", p], "left")
        known = F.array_compact(F.array(F.coalesce("seed", "s_i"), "s_l", "s_r"))
        base = _logit(PRIOR)
        odds = F.aggregate(known, F.lit(base), lambda a, x: a + F.log(F.greatest(x, F.lit(0.01)) / F.greatest(1 - x, F.lit(0.01))) - F.lit(base))
        mention = step.filter(F.size(known) > 0).withColumn("m", 1 / (1 + F.exp(-odds)))
        scored = mention.select("q", "m", "n", each).filter("x.v IS NOT NULL").groupBy("q", "x.p", "x.v").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("s")).checkpoint()
    out = Knowledge(*[{q: {} for own in QUESTIONS.values() for q in own} for _ in range(3)])
    target = dict(zip("ilr", (out.instance, out.before, out.after)))
    for q, p, value, s in scored.collect():  # at most 1 / share rows a class and part
        target[p][q][value] = s
    for q, own in SEEDS.items():  # seeds stay fixed, also those that no text holds
        out.instance[q].update(own)
    return out


class Extractor:
    """Finds the mentions of one text."""

    def __init__(self, knowledge: Knowledge) -> None:
        self.known = knowledge.evidence()
        self.base = _logit(PRIOR)
        self.parts = {q: (self.known.instance[q], self.known.before[q], self.known.after[q]) for q in self.known.instance}
        _, self.name_before, self.name_after = self.parts["person_name"]
        own = [self.known.instance[q] for q in QUESTIONS["number"]]
        self.alone = {form: max(x.get(form, -9.0) for x in own) for form in set().union(*own)}
        self.role = Memo(self._role_of, 1 << 16)
        self.given = {fold(i) for i, s in knowledge.instance["person_name"].items() if s >= ACCEPT and not _TITLE[i] and not _IS_PARTICLE.fullmatch(i.lower()) and len(i) > 2}
        self.first: dict[str, float] = {}
        for i, x in self.known.instance["person_name"].items():
            self.first[fold(i)] = max(x, self.first.get(fold(i), x))
        #: The same of a word as it is spelt.
        self.spelt = Memo(lambda word: self.first.get(fold(_GIVEN[word]), 0.0), 1 << 16)

    def odds(self, question: str, instance: str, before: str, after: str) -> float:
        """Log-odds that a mention is of the type."""
        i, l, r = self.parts[question]
        return self.base + i.get(instance, 0.0) + l.get(before, 0.0) + r.get(after, 0.0)

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(type, start, end)``, in order, without overlaps."""
        return [] if not text or text.isspace() else self.decide(text, scan(text))

    def decide(self, text: str, found: Scan) -> list[tuple[str, int, int]]:
        """The same, of a text that was scanned."""
        masks = has_masks(text)
        spans = [("email", a, b) for a, b, form, before, after in found.mails if self.odds("email", form, before, after) >= 0]
        spans += self._numbers(text, found.numbers, masks)
        kinds, odds = self.known.instance["street_address"], self.odds
        for start, end, kind, before, after in found.streets:
            if kinds.get(kind, 0.0) > -2 and odds("street_address", kind, before, after) >= 0 and not (masks and _masked(text, start, end)):
                spans.append(("street_address", start, end))
        spans += self._names(text, found.words, [(a, b) for _, a, b in spans], masks)
        spans.sort(key=lambda s: (s[1], -s[2]))
        out: list[tuple[str, int, int]] = []
        for s in spans:
            if not out or s[1] >= out[-1][2]:
                out.append(s)
        return out

    def _numbers(self, text: str, numbers: list[tuple[int, int, str, str, str]], masks: bool) -> Iterator[tuple[str, int, int]]:
        known = self.known
        for low, high, whole, *patterns in numbers:
            if self.alone.get(whole, 0.0) <= -2.5:
                continue  # a shape that is certainly neither needs no context and has no parts
            if whole.count("(") == whole.count(")") and not (masks and _masked(text, low, high)):
                best, question = max([(self.odds(q, whole, *patterns), q) for q in QUESTIONS["number"]])
                if best >= 0:
                    if question == "phone" and (x := EXTENSION.match(text, high)):
                        high = x.end()
                    yield question, low, high
                    continue
            groups = [(low + g.start(), low + g.end()) for g in _GROUPS.finditer(text[low:high])]
            n, done = len(groups), False
            for size in range(n, 0, -1):
                for first in range(n - size + 1):
                    start, end = groups[first][0], groups[first + size - 1][1]
                    value = text[start:end]
                    digits = len(_DIGIT.findall(value))
                    if digits < 5 or value.count("(") != value.count(")"):
                        if value.startswith("(") and ")" not in value:
                            start, value = start + 1, value[1:]
                        elif value.endswith(")") and "(" not in value:
                            end, value = end - 1, value[:-1]
                        if digits < 5:
                            continue
                    form = shape(value)
                    alone = self.alone.get(form, 0.0 if size == n else -9.0)
                    # a part must be known by its shape
                    if size < n and alone + self.base < 0 or masks and _masked(text, start, end):
                        continue
                    before, after = patterns if (start, end) == (low, high) else context(text, start, end)
                    best, question = max((self.odds(q, form, before, after), q) for q in QUESTIONS["number"])
                    if size < n and known.instance[question].get(form, 0.0) + self.base < 0:
                        continue
                    if best >= 0:
                        if question == "phone" and (x := EXTENSION.match(text, end)):
                            end = x.end()
                        yield question, start, end
                        done = True
                        break
                if done:
                    break

    def _role_of(self, word: str) -> int:
        """1: given name, 2: title, 3: initials, 0: any other word."""
        bare = word.rstrip(".")
        given = len(bare) > 2 and not bare.isupper() and fold(_GIVEN[bare]) in self.given
        return 2 if _TITLE[bare] else 3 if word[-1:] == "." else 1 if given else 0

    def _name_odds(self, word: str, before: str, after: str) -> float:
        """Log-odds of a full name, its first word in any spelling that scanners confuse."""
        return self.base + self.name_before.get(before, 0.0) + self.name_after.get(after, 0.0) + self.spelt[word]

    def _untitled(self, text: str, start: int, after: int, rest: Rest, before: str, behind: str) -> tuple[Rest, bool] | None:
        """The rest of a pair whose first word is no known given name, and whether its parts and context make it a name."""
        word = text[start:after]
        if SEEDS["street_address"].get(word.lower()) == 0:
            return rest, False  # a month or a part of a paper
        role = self.role[text[rest[2] : rest[3]]]
        if role == 2 or role == 1 and _AFTER_GIVEN.match(text, rest[0]):
            return None  # a full name begins behind this word
        best, since = self._name_odds(word, before, behind), after
        if best >= 0 and (longer := _rest(text, rest[0])):
            last = text[longer[2] : longer[3]]
            if len(last) > 2 and not self.role[last] and not _BREAK.search(text, rest[0], longer[0]):
                more = self._name_odds(word, *context(text, start, longer[0]))
                if more > best:
                    best, since, rest = more, rest[0], longer
        if best >= 0 and _BREAK.search(text, since, rest[0]):
            # across a line's end both sides must speak for a name
            before, behind = context(text, start, rest[0])
            best = min(self.known.before["person_name"].get(before, 0.0), self.known.after["person_name"].get(behind, 0.0)) or -1.0
        return rest, best >= 0 and rest[3] - rest[2] > 2

    def _names(self, text: str, words: list, taken: list[tuple[int, int]], masks: bool) -> list[tuple[str, int, int]]:
        blocked = _marked(text, taken)
        found: list[tuple[int, int]] = []
        surnames: set[str] = set()
        french = None
        past, tried, titled = 0, 0, -1

        def add(start: int, end: int, *parts: str) -> None:
            if blocked.find(1, start, end) < 0 and not (masks and _MASK.search(text, max(0, start - 1), end + 1)) and not in_company(text, start, end):
                found.append((start, end))
                for part in parts:
                    surnames.add(_SURNAME_KEY[part])

        roles = self.role
        for entry in words:
            start = entry[0]
            if start < past:
                continue
            after = entry[1]
            word = text[start:after]
            role = roles[word]
            if start and text[start - 1] in "-‐":
                continue
            if not role and text[after] != ",":
                # the same pairs as are counted: one that is no name takes its words, too
                if start >= tried and len(word) > 2 and not word.isupper():
                    rest, before, behind = entry[2:] if len(entry) > 2 else (None, "", "")
                    if rest is None and (rest := _rest(text, after)):
                        before, behind = context(text, start, rest[0])
                    if rest is not None and (pair := self._untitled(text, start, after, rest, before, behind)):
                        rest, tried = pair[0], pair[0][0]
                        if pair[1]:
                            add(start, tried, text[rest[1] : tried], text[rest[2] : rest[3]])
                            past = tried
                continue
            rest, name_start = None, start
            if role == 3 and word == "M.":
                if french is None:
                    french = _FRENCH.search(text) is not None
                if french:
                    role = 2
            if role == 2:
                rest = _rest(text, after, _AFTER_TITLE)
                if rest:
                    name_start, last = rest[1], text[rest[2] : rest[3]]
                    if self.role[last] or text[rest[0] : rest[0] + 1] == "," and self._reversed(text, last, rest[0]):
                        titled = name_start
                        continue  # the next words are a full name
            elif role == 3 and word.count(".") > 1 and "-" not in word:
                continue  # bare initials stand for a withheld name
            elif role:
                rest = entry[2] if len(entry) > 2 else _rest(text, after)
                if rest and role == 1:
                    if self.role[text[rest[2] : rest[3]]] == 1 and (longer := _rest(text, rest[0])) and not _BREAK.search(text, rest[0], longer[0]):
                        rest = longer
                    if start != titled:
                        patterns = entry[3:] if len(entry) > 2 and rest is entry[2] else context(text, start, rest[0])
                        if self._name_odds(word, *patterns) < 0:
                            continue
            elif end := self._reversed(text, word, after):
                lead = _LEADING_CAPS.search(text[max(0, start - 12) : start]) if word.isupper() else None
                first = start - len(lead.group()) if lead else start
                add(first, end, text[first:after], word)
                past = end
                continue
            if rest is None or rest[3] - rest[2] < 3 or self.role[text[rest[2] : rest[3]]] == 2:
                continue
            add(name_start, rest[0], text[rest[1] : rest[0]], text[rest[2] : rest[3]])
            past = rest[0]
        if surnames:
            done = _marked(text, found)
            for start, end in self._again(text, surnames, done):
                if self.role[text[start:end]] in (0, 3):
                    m = _LEADING.search(text[max(0, start - 12) : start])
                    if m and _SPACE.sub("", m.group() + text[start:end]).lower() in surnames:
                        start -= len(m.group())
                    add(start, end)
        return [("person_name", a, b) for a, b in found]

    @staticmethod
    def _again(text: str, surnames: set[str], done: bytearray) -> list[tuple[int, int]]:
        """Where one of the surnames stands as a capitalised word, outside the names that are marked as done."""
        low = text.lower()
        if len(low) != len(text):  # letters whose small form is longer
            low = "".join([c.lower() if len(c.lower()) == 1 else c for c in text])
        out = []
        for surname in surnames:
            size, at = len(surname), low.find(surname)
            while at >= 0:
                before = text[at - 1 : at]
                if done.find(1, at, at + size) < 0 and not (before and before.isalnum()):
                    first = at
                    if before and before in "-‐'’.":  # the word may have begun before
                        first = max(0, at - 1 - len(text[max(0, at - 60) : at].rsplit(None, 1)[-1]))
                    for m in _CAPITAL_WORD.finditer(text, first, at + size + 60):
                        if m.start() >= at:
                            if m.start() == at and m.end() == at + size:
                                out.append((at, at + size))
                            break
                        if m.end() > at:
                            break
                at = low.find(surname, at + 1)
        return out

    def _reversed(self, text: str, word: str, end: int) -> int:
        """End of ``, Given`` after a surname, 0 if there is none."""
        m = _COMMA_GIVEN.match(text, end)
        if m is None or self.role[m.group(1)] != 1:
            return 0
        return m.end() if word.isupper() or _MORE_NAME.match(text, m.end()) is None else 0


def _extract(df: DataFrame, key: str, text: str, knowledge: Knowledge | None, emit, schema: str, arrow: pa.Schema) -> DataFrame:
    if knowledge is None:
        table = _scanned(df, key, text)
        knowledge = _learned(table.filter("cls IS NOT NULL").select("cls", "i", "l", "r", "n"))
        rows = table.filter("cls IS NULL").select("k", "t", "scan")
    else:
        rows = _texts(df, key, text).withColumn("scan", F.lit(None).cast("binary"))
    shared = df.sparkSession.sparkContext.broadcast(knowledge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        gc.disable()  # nothing here is cyclic
        for batch in batches:
            out = []
            for k, t, found in zip(*[c.to_pylist() for c in batch.columns]):
                out += emit(k, t, extractor.find(t) if found is None else extractor.decide(t, Scan.unpacked(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def find_personal_info(df: DataFrame, key: str, text: str, knowledge: Knowledge | None = None) -> DataFrame:
    """``key``, ``pii_type``, ``pii_text``: each different value of each text."""

    def emit(k, t, spans):
        return {(k, kind, " ".join(t[a:b].split())): None for kind, a, b in spans}

    arrow = pa.schema([("k", pa.int64()), ("pii_type", pa.string()), ("pii_text", pa.string())])
    return _extract(df, key, text, knowledge, emit, "k bigint, pii_type string, pii_text string", arrow).withColumnRenamed("k", key)


def redact(df: DataFrame, key: str, text: str, knowledge: Knowledge | None = None) -> DataFrame:
    """``key``, ``redacted`` (typed placeholders in place of the values), ``findings``."""

    def emit(k, t, spans):
        parts, last = [], 0
        for kind, a, b in spans:
            parts += [t[last:a], f"[{kind.upper()}]"]
            last = b
        return [(k, t if t is None else "".join([*parts, t[last:]]), len(spans))]

    arrow = pa.schema([("k", pa.int64()), ("redacted", pa.string()), ("findings", pa.int32())])
    return _extract(df, key, text, knowledge, emit, "k bigint, redacted string, findings int", arrow).withColumnRenamed("k", key)
