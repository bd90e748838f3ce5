"""Tokens of the SELECT dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from millrace.errors import MalformedData

KEYWORDS = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AS AND NOT LIKE IN CASE WHEN THEN ELSE END EXTRACT DISTINCT COUNT SUM AVG MIN MAX CREATE".split()
)
_LEXEME = re.compile(
    r"\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<text>'(?:[^']|'')*')|(?P<sign><>|!=|<=|>=|[=<>+\-*(),.;])|(?P<end>$)|(?P<bad>.))",
    re.ASCII | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    """``kind`` is keyword, name, number, text, sign or end; ``at`` a byte offset."""

    kind: str
    value: str
    at: int


def tokenize(sql: str) -> list[Token]:
    """All tokens, the last of kind ``end``."""
    out, position = [], 0
    while True:
        m = _LEXEME.match(sql, position)
        kind = m.lastgroup
        value = m.group(kind)
        at = len(sql[: m.start(kind)].encode("utf-8"))
        if kind == "bad":
            raise MalformedData("unterminated string" if value == "'" else f"unexpected character {value!r}", at)
        if kind == "word":
            upper = value.upper()
            out.append(Token("keyword", upper, at) if upper in KEYWORDS else Token("name", value, at))
        elif kind == "text":
            out.append(Token("text", value[1:-1].replace("''", "'"), at))
        else:
            out.append(Token(kind, value, at))
        if kind == "end":
            return out
        position = m.end()
