"""Personal information in generated rulings, whose true values are known."""

import random

import pytest

from millrace.llm import personal_info as op

GIVEN = ["Samuel", "Priya", "Helen", "Marcus", "Laura", "Owen"]
SURNAMES = ["Thornquist", "Wickham", "Pellmere", "Drayby", "Luddcombe", "Brinard", "Mosgate"]


def phone(rng):
    n = f"{rng.randint(0, 999999):06d}"
    return rng.choice([f"+44 1632 {n}", f"01632 {n}", f"07700 {n}", f"+1 555-555-{n[:4]}", f"(555) 555-{n[:4]}"])


def ruling(rng):
    """Text and the true (type, value) pairs."""
    a, b = rng.sample(SURNAMES, 2)
    g, h = rng.sample(GIVEN, 2)
    tel, mail = phone(rng), f"{g.lower()}.{a.lower()}@mail.example"
    nino = f"QQ {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} C"
    street = f"{rng.randint(1, 180)} {rng.choice(['Copper', 'Juniper', 'Anchor'])} {rng.choice(['Mill ', 'Hill ', ''])}{rng.choice(['Road', 'Street', 'Lane', 'Close'])}"
    lines = [
        f"{g} {a} v Kelmore Foods Ltd",
        f"The witness {h} {b} (born 3 March 1970, National Insurance no. {nino}) produced the lease.",
        f"Mr {a} resided at {street} until 4 May 2001.",
        f"The tenant could be reached only by telephone on {tel}, as Mrs {b} confirmed.",
        f"Copies were lodged under reference {rng.randint(10, 99)}/{rng.randint(1000, 9999)}/2050 and invoice R-2090-{rng.randint(10000, 99999)}.",
        f"In evidence {g[0]}. {a} stated that nobody knew. Messages to {mail} went unanswered.",
        f"No one from {b} Energy plc attended. {b}'s account differs.",
    ]
    true = {("email", mail), ("phone", tel), ("id_number", nino), ("street_address", street)}
    true |= {("person_name", v) for v in (f"{g} {a}", f"{h} {b}", a, b, f"{g[0]}. {a}")}
    return "\n\n".join(lines), true


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    made = [ruling(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(made)], "doc_id bigint, text string, pii_type string")
    return df, made, op.learn(df, "text")


def test_found_values(corpus):
    df, made, known = corpus
    got: dict[int, set] = {}
    for r in op.find_personal_info(df, "doc_id", "text", known).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_type, r.pii_text))
    hit = sum(len(got.get(i, set()) & true) for i, (_, true) in enumerate(made))
    assert hit / sum(len(true) for _, true in made) > 0.97
    assert hit / sum(map(len, got.values())) > 0.97


def test_unseeded_shapes_are_discovered(corpus):
    known = corpus[2]
    assert known.instance["phone"]["##### ######"] > 0.5
    assert known.instance["street_address"]["close"] > 0.5 and known.instance["street_address"]["lane"] > 0.5
    assert known.instance["person_name"]["Priya"] > 0.5


def test_redaction_leaves_the_rest(corpus):
    df, made, known = corpus
    text, true = made[0]
    out = op.redact(df.filter("doc_id = 0"), "doc_id", "text", known).collect()[0]
    rest = text
    for kind, value in sorted(true, key=lambda x: -len(x[1])):
        rest = rest.replace(value, f"[{kind.upper()}]") if kind != "person_name" or " " in value else rest
    assert out.findings >= len(true) and "Kelmore Foods Ltd" in out.redacted and "reference" in out.redacted
    assert not any(v in out.redacted for k, v in true if k != "person_name")


def test_edges(spark, corpus):
    known = corpus[2]
    e = op.Extractor(known)
    assert e.find(None) == [] and e.find("") == [] and e.find(" \n\t ") == []
    text = "Mrs\nDrayby and DRAYBY, Samuel wrote to a.b [at] box (dot) test; tel. +44 1632 96••••."
    assert [(k, text[a:b]) for k, a, b in e.find(text)] == [("person_name", "Drayby"), ("person_name", "DRAYBY, Samuel"), ("email", "a.b [at] box (dot) test")]
    assert e.find("Mr S. and Drayby Energy Ltd of Copper Road, ***@***") == []
    long = "nothing here. " * 100_000 + "Mr Drayby."
    assert [long[a:b] for _, a, b in e.find(long)] == ["Drayby"]
    rows = [(1, "Mr Drayby. Mr Drayby."), (1, "Mr Drayby."), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [tuple(r) for r in op.find_personal_info(df, "doc_id", "text", known).collect()] == [(1, "person_name", "Drayby")] * 2
    assert {r.doc_id: r.redacted for r in op.redact(df.filter("doc_id > 1"), "doc_id", "text", known).collect()} == {2: None, 3: ""}


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.find_personal_info(df, "doc_id", "text").count() == 0


def test_wraps_and_decomposed_letters(corpus):
    e = op.Extractor(corpus[2])
    text = "Mr Zieselmöller called; tel. (555)\r\n555-0150; N.N.\nThe Wickham Energy Ltd paid. National Insurance no. QQ 12 34 56 C. The rest."
    got = [(k, text[a:b]) for k, a, b in e.find(text)]
    assert got == [("person_name", "Zieselmöller"), ("phone", "(555)\r\n555-0150"), ("id_number", "QQ 12 34 56 C")]


def test_fit_counts_every_text(spark, corpus):
    df, _, known = corpus
    more = spark.range(40_000).selectExpr("id as doc_id", "'' as text", "'' as pii_type")
    got = op.learn(df.unionByName(more), "text")
    for mine, all_texts in ((got.instance, known.instance), (got.before, known.before), (got.after, known.after)):
        for q, scores in all_texts.items():
            assert mine[q] == pytest.approx(scores)


def test_context_decides_rare_given_names(corpus):
    e = op.Extractor(corpus[2])
    text = "The witness Xanthippe Zabriskovic (born 3 March 1970, National Insurance no. QQ 12 34 56 C) produced the lease. In the end Zabriskovic agreed. The Xanthippe Settlement stands."
    assert [text[a:b] for k, a, b in e.find(text) if k == "person_name"] == ["Xanthippe Zabriskovic", "Zabriskovic"]
    assert e.find("Nothing of Xanthippe Zabriskovic here.") == []


PIECES = ["A", "Ö", "ö", "'", "’", "-", "‐", ".", "_", ",", " ", " ", " ", "\n", "\r\n", "\xa0", "\t", "1", "12", "4567", "٣", "²", "x", "s", "ß", "McNair", "O'Dray", "von", "van der", "de", "d'", "la", "Le", "Hauptstr.", "Ringstraße", "Hill Road", "rue de", "bis", "the", "AB", "@", "[at]", "( AT )", "<", "\0", "𝟗", "🙂"]


def _slow_words(text):
    return [m.span() for m in op._NAME_PART.finditer(text) if not (m.start() and text[m.start() - 1].isalnum())]


def _fast_words(text, words):
    out, taken = [], 0
    for start, end in words:
        m = op._NAME_PART.match(text, start) if start >= taken else None
        if m:
            assert end in (-1, m.end())
            taken = m.end()
            if not (start and text[start - 1].isalnum()):
                out.append(m.span())
        else:
            assert start < taken or end < 0
    return out


def _fast_matches(pattern, text, starts):
    out, past = [], 0
    for at in starts:
        if at >= past and (m := pattern.match(text, at)):
            past = m.end()
            out.append(m.span())
    return out


def test_spots_of_many_texts_are_those_of_the_patterns():
    rng = random.Random(5)
    cluster, behind = op.re.compile(r"\d(?<!\d\d)(?:\D{0,3}+\d){4,}+"), op.re.compile(r"[ \n\xa0](?=\d)(?<=[a-zß.\r][ \n\xa0])\d{1,4}+(?!\d)")
    texts = [ruling(rng)[0] for _ in range(30)] + ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(3000)]
    assert len(found := op.spots(texts)) == len(texts)
    for text, s in zip(texts, found):
        assert s.clusters == [m.span() for m in cluster.finditer(text)]
        for pattern, starts in ((op._AT, s.signs), (op._STREET_FROM, s.fronts)):
            assert _fast_matches(pattern, text, starts) == [m.span() for m in pattern.finditer(text)]
        street = [m.start() + 1 for m in behind.finditer(text) if op._STREETY.f(text[text.rfind(" ", max(0, m.start() - 47), m.start()) + 1 or max(0, m.start() - 47) : m.start()])]
        assert set(street) <= set(s.behind) <= {m.start() + 1 for m in behind.finditer(text)}
        assert _fast_words(text, s.words) == _slow_words(text)
    assert [*op.scans(texts)] == [op.scan(t) for t in texts]
