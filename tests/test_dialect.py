"""Lexer, parser and grammar limits."""

import pytest

from millrace.ast import Agg, Arith, Case, Num, Ref, Star, Str, label
from millrace.errors import InvalidArgument, MalformedData, Unsupported
from millrace.lexer import tokenize
from millrace.parser import parse


def kinds(sql):
    return [(t.kind, t.value) for t in tokenize(sql)]


def test_tokens_and_case():
    assert kinds("select Distinct name, COUNT(*)") == [
        ("keyword", "SELECT"), ("keyword", "DISTINCT"), ("name", "name"), ("sign", ","), ("keyword", "COUNT"), ("sign", "("), ("sign", "*"), ("sign", ")"), ("end", ""),
    ]


def test_string_escape_and_numbers():
    assert kinds("'abc''def' 10.5 7")[:3] == [("text", "abc'def"), ("number", "10.5"), ("number", "7")]


@pytest.mark.parametrize("sql", ["'open", "@", 'a "b"', "a / b"])
def test_bad_characters(sql):
    with pytest.raises(MalformedData):
        tokenize(sql)


def test_offsets_are_bytes():
    assert tokenize("'é' x")[1].at == 5


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a FROM t JOIN u",
        "SELECT a FROM t WHERE a = 1 OR b = 2",
        "SELECT a FROM t WHERE NOT a = 1",
        "SELECT a FROM t WHERE a BETWEEN 1 AND 2",
        "SELECT a FROM t WHERE a IS NULL",
        "SELECT DISTINCT a FROM t",
        "SELECT a FROM t WHERE a NOT IN (1)",
        "SELECT COUNT(*) + 1 FROM t",
        "SELECT a FROM t UNION SELECT a FROM u",
        "SELECT a FROM t WHERE (a + 1) > 2",
        "SELECT a",
        "",
    ],
)
def test_rejected(sql):
    with pytest.raises(MalformedData):
        parse(sql)


def test_subquery_unsupported():
    with pytest.raises(Unsupported):
        parse("SELECT (SELECT a FROM t) FROM t")


@pytest.mark.parametrize("tail", ["LIMIT 1.5", "LIMIT x", "LIMIT 99999999999999999999"])
def test_bad_limits(tail):
    with pytest.raises(InvalidArgument):
        parse(f"SELECT a FROM t {tail}")


def test_tree():
    q = parse("SELECT t.a + 1 AS x, -b y, COUNT(DISTINCT c), CASE WHEN a = 1 AND b <> 2 THEN 'p' ELSE 'q' END FROM T AS t GROUP BY x ORDER BY x DESC, y ASC LIMIT 3 OFFSET 4;")
    assert q.items[0].alias == "x" and q.items[1].alias == "y"
    assert q.items[1].expr == Arith("-", Num("0"), Ref("b"))
    assert q.items[2].expr == Agg("COUNT", Ref("c"), True)
    assert isinstance(q.items[3].expr, Case) and (q.limit, q.offset) == (3, 4)
    assert [o.descending for o in q.order] == [True, False]


def test_labels():
    q = parse("SELECT COUNT(*), SUM(t.x), COUNT(DISTINCT x), a + 1, -x, EXTRACT(MINUTE FROM ts), strlen(a), t.x, 'v', 1 FROM t")
    assert [label(i.expr) for i in q.items] == ["COUNT(*)", "SUM(t.x)", "COUNT(DISTINCT x)", "a + 1", "0 - x", "EXTRACT(minute, ts)", "STRLEN(a)", "x", "v", "1"]
    assert label(Star()) == "*" and label(Str("s")) == "s"


@pytest.mark.parametrize("sql", ["SELECT SUM(DISTINCT a) FROM t", "SELECT SUM(*) FROM t", "SELECT MIN(*) FROM t"])
def test_unsupported_aggregates(sql):
    with pytest.raises(Unsupported):
        parse(sql)
