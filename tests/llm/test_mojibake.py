"""Wrong encodings: learned from twins, found and repaired."""

import pytest

from millrace.llm import mojibake as op

WORDS = ["crème", "forêt", "hôtel", "größe", "über", "straße", "ação", "verão", "książki", "żółty", "części"]
CYRILLIC = ["погода", "сегодня", "купить", "рецепты", "новости", "велосипед"]


@pytest.mark.parametrize("meant,read", [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp1251"), ("cp1251", "koi8_r"), ("utf_8", "cp437")])
def test_garble_and_restore(meant, read):
    for word in CYRILLIC:
        seen = op.garble(word, meant, read)
        assert seen != word and op.restore(seen, meant, read) == word
        assert (meant, read, 1) in op.explanations(word, seen)


def test_explanations_need_equal_frames():
    assert op.explanations("crème", "cremé") == [] and op.explanations("abc", "abc") == []
    twice = op.garble(op.garble("é", "utf_8", "cp1252"), "utf_8", "cp1252")
    assert ("utf_8", "cp1252", 2) in op.explanations("forét", f"for{twice}t")


def rows():
    out, i = [], 0

    def put(title, url, n=1):
        nonlocal i
        for _ in range(n):
            out.append((i, title, url, "extra"))
        i += 1

    for w in WORDS + CYRILLIC:
        put(f"{w} shop", f"http://a.test/{w}", 40)
    for w in WORDS:
        put(op.garble(w, "utf_8", "cp1252") + " shop", "http://a.test/x")
    for w in CYRILLIC:
        put(op.garble(w, "cp1251", "koi8_r"), None)
        put(op.garble(w, "utf_8", "cp1251"), "")
    return out


def test_found_and_repaired(spark):
    base = rows()
    n = base[-1][0] + 1
    more = [
        (n, "verão caf�", "http://a.test/for%C3%83%C2%AAt-1"),
        (n + 1, "AÇÃO № 5 — 50 €  &eacute;", "http://a.test/for%C3%AAt?x=%D0%B4"),
        (n + 2, op.garble(op.garble("forêt", "utf_8", "latin_1"), "utf_8", "latin_1"), "http://a.test/%zz%"),
        (n + 3, "CZĘŚCI " + "é" * 50_000, None),
        (None, op.garble("über", "utf_8", "cp1252"), None),
    ]
    df = spark.createDataFrame(base + [(*m, "x") for m in more] + [(*more[0], "x")] * 2, "WatchID bigint, Title string, URL string, field string")
    got = {(r.WatchID, r.field): r.repaired for r in op.garbled_fields(df, "WatchID", ["Title", "URL"], ["URL"]).collect()}
    clean = len(WORDS) + len(CYRILLIC)
    for k, w in enumerate(WORDS):
        assert got.pop((clean + k, "Title")) == w + " shop"
    for k, w in enumerate(CYRILLIC):
        assert got.pop((clean + len(WORDS) + 2 * k, "Title")) == w and got.pop((clean + len(WORDS) + 2 * k + 1, "Title")) == w
    assert got == {(n, "Title"): "verão caf�", (n, "URL"): "http://a.test/for%C3%AAt-1", (n + 2, "Title"): "forêt", (None, "Title"): "über"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "WatchID bigint, Title string, URL string")
    assert op.garbled_fields(df, "WatchID", ["Title", "URL"], ["URL"]).count() == 0


def test_hot_garbled_value(spark):
    base = rows()
    n = base[-1][0] + 1
    base += [(n + i, f"{CYRILLIC[0]} {i}", None, "x") for i in range(5)]
    hot = op.garble(CYRILLIC[0], "cp1251", "koi8_r") + " shop"
    base += [(n + 10 + i, hot, None, "x") for i in range(500)]
    df = spark.createDataFrame(base, "WatchID bigint, Title string, URL string, field string")
    got = [r for r in op.garbled_fields(df, "WatchID", ["Title", "URL"], ["URL"]).collect() if r.stored == hot]
    assert len(got) == 500 and {r.repaired for r in got} == {CYRILLIC[0] + " shop"}


def test_twins_beside_a_hot_title(spark):
    greek = ["καιρός", "σήμερα", "αγορά", "συνταγές"]
    counted = [(w, 40, 5) for w in greek] + [(op.garble(w, "iso8859_7", "cp1252"), 1, 1) for w in greek] + [(w, 1_000_000, 1) for w in CYRILLIC]
    words = spark.createDataFrame(counted, "w string, n bigint, v bigint")
    assert ("iso8859_7", "cp1252") in op.learn_transformations(words)


@pytest.mark.parametrize("meant,read", [("utf_8", "gbk"), ("utf_8", "cp1255"), ("cp1256", "cp1252"), ("cp1255", "cp1252"), ("utf_8", "mac_greek")])
def test_encodings_of_no_list_are_learned(spark, meant, read):
    clean = {"cp1256": ["مرحبا", "سلام", "كتاب", "مدرسة", "طريق", "مدينة"], "cp1255": ["שלום", "מחשב", "ספריה", "תפוחים", "חנות", "עיתון"]}.get(meant, CYRILLIC)
    assert (meant, read) not in op.COMMON
    rows = [(i, f"{w} shop", None) for i, w in enumerate(clean * 5)]
    rows += [(100 + i, f"{op.garble(w, meant, read)} shop", None) for i, w in enumerate(clean) if op.garble(w, meant, read)]
    df = spark.createDataFrame(rows, "WatchID bigint, Title string, URL string")
    got = {r.WatchID - 100: r.repaired for r in op.garbled_fields(df, "WatchID", ["Title", "URL"], ["URL"]).collect()}
    assert len(got) >= 4 and all(got[i] == f"{clean[i]} shop" for i in got)


def test_joined_like_sent(spark):
    base = rows()
    n = base[-1][0] + 1
    more = [(n, "verão caf\ufffd", "http://a.test/for%C3%83%C2%AAt-1", "x"), (n + 1, None, "", None), (n + 2, "caf\ufffd", None, None)]
    df = spark.createDataFrame([*base, *more, *base[-3:]], "WatchID bigint, Title string, URL string, field string")
    for distinct in (True, False):
        sent, joined = (sorted(map(tuple, op.garbled_fields(df, "WatchID", ["Title", "URL"], ["URL"], distinct, bound).collect())) for bound in (op.SENT_WORDS, 0))
        assert sent == joined and len(sent) > 20


def test_no_word_is_too_rare_to_prove_a_repair(spark):
    counted = [(w, 1000, 500) for w in CYRILLIC] + [(op.garble(w, "cp1251", "koi8_r"), 1, 1) for w in CYRILLIC]
    counted += [("журавль", 3, 3), (op.garble("журавль", "cp1251", "koi8_r"), 1, 1), ("погода\u0301", 10**9, 10**9)]
    words = spark.createDataFrame(counted, "w string, n bigint, v bigint")
    got = {r.w: r.out for r in op.restored_words(words, [("cp1251", "koi8_r")]).collect()}
    assert got[op.garble("журавль", "cp1251", "koi8_r")] == "журавль" and "журавль" not in got


def test_rare_characters_of_three_bytes(spark):
    words = spark.createDataFrame([(op.garble("漢字", "utf_8", "cp1252"), 1, 1), (op.garble("ok🙂", "utf_8", "latin_1"), 1, 1), ("CZĘŚCI", 1, 1)], "w string, n bigint, v bigint")
    got = {r.w: r.out for r in op.restored_words(words, [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp1250")]).collect()}
    assert sorted(got.values()) == ["ok🙂", "漢字"]
