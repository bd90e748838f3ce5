"""Held-out passages in documents."""

import random

from millrace.llm import leakage as op

ITEM = "A florist from Langbrook stored seventy crates of a fishing vessel in a shed near Ivelwick, and after the lift jammed the tender named EUR 1,310 as the only remedy for nobody. Does the straße lease bar Café Glass plc from asking?"
WORDS = ITEM.split()


def found(text, items=((7, ITEM),)):
    return [p[0] for p in op.Matcher(items).passages(text)]


def test_whole_and_passages():
    assert found(f"Before. {ITEM} After.") == [7]
    assert found("x " + " ".join(WORDS[5:25]) + " y") == [7]
    assert found("x " + " ".join(WORDS[5:16]) + " y") == []
    assert found(ITEM.upper().replace("STRASSE", "STRASSE")) == [7]
    assert found("") == [] and found(None) == [] and found("\n \t") == []


def test_tolerances():
    text = " ".join(WORDS[3:27])
    assert found(text.replace("shed", "sh-\r\ned").replace(" crates of", "\n\ncrates\xa0of")) == [7]
    assert found(text.replace(" crates", " cratcs")) == [7]
    assert found(text.replace("in a shed", "in - 12 - Smith v Jones (2004) a shed")) == [7]
    assert found(text.replace(",", " ;").replace("EUR 1,310", "EUR 1310")) == [7]


def test_lookalike_with_other_slots():
    other = ITEM
    for a, b in (("florist", "baker"), ("Langbrook", "Kelmore"), ("seventy", "14"), ("fishing vessel", "bath plug"), ("Ivelwick", "Waindale"), ("lift jammed", "mill burned"), ("tender", "lease"), ("1,310", "99")):
        other = other.replace(a, b)
    assert found(" ".join(other.split()[:33])) == []


def test_offsets_point_into_the_text():
    text = "Ünrelated… " * 50 + ITEM + " end"
    ((_, first, last, start, end),) = op.Matcher([(1, ITEM)]).passages(text)
    assert text[start:end] == ITEM[:-1] and (first, last) == (0, len(WORDS) - 1)


def test_random_passages_against_brute_force():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=90))) for i in range(40)]
    matcher = op.Matcher(items)
    for _ in range(150):
        item, text = rng.choice(items)
        words = text.split()
        size = rng.choice([8, 10, 20, 25, 60, 90])
        at = rng.randint(0, len(words) - size)
        filler = lambda: rng.choices(vocabulary, k=rng.randint(0, 80))
        doc = " ".join([*filler(), *words[at : at + size], *filler()])
        assert ([p[0] for p in matcher.passages(doc)] == [item]) == (size >= 20)


def test_tables(spark):
    docs = spark.createDataFrame([(1, f"a {ITEM}", "z"), (2, None, None), (3, "", None), (4, f"{ITEM} b", None), (4, f"{ITEM} b", None)], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "short one here")], "item_id bigint, text string")
    got = op.leaked_passages(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7), (4, 7), (4, 7)]
    assert op.leaked_passages(docs, "doc_id", "text", items.filter("false"), "item_id", "text").count() == 0
    assert op.leaked_passages(docs.filter("false"), "doc_id", "text", items, "item_id", "text").count() == 0


def test_ids_with_several_texts():
    long, short = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(25))
    for items in ([(7, long), (7, short)], [(7, short), (7, long)]):
        assert found(f"x {long} y", items) == [7] and found(f"x {short} y", items) == [7]
        assert found(f"{short} and {long}", items) == [7, 7]


def test_an_altered_word_and_a_header_together():
    words = [f"word{i}" for i in range(60)]
    text = words[10:30]
    text[5] = "altered"
    text[9:9] = "- 3 - Smith v Jones".split()
    assert found(" ".join(["before", *text, "after"]), [(1, " ".join(words))]) == [1]


def test_a_chance_word_before_does_not_hide_a_passage():
    words = [f"word{i}" for i in range(80)]
    text = words[20:52]
    text[8], text[20] = "altered", "changed"
    doc = " ".join(["so", words[17], "a", "b", *text, "end"])
    assert [p[:3] for p in op.Matcher([(1, " ".join(words))]).passages(doc)] == [(1, 20, 51)]


def test_many_places_of_one_word():
    item = " ".join(f"the word{i}" for i in range(30))
    text = "the the the the the the " * 10 + item + " the the the the the" * 10
    assert found(text, [(3, item)]) == [3]


def test_joined_like_broadcast(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(60)]  # runs are shared between items
    items = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 19, 40, 90])))) for i in range(60)]
    docs = []
    for i in range(120):
        words = rng.choice(items)[1].split()
        if len(words) > 25:
            at = rng.randint(0, len(words) - 22)
            words = words[at : at + rng.randint(15, 40)]
        if len(words) > 10 and i % 3:
            words[rng.randrange(len(words))] = "altered"
        docs.append((i // 2, " ".join([*rng.choices(vocabulary, k=30), *words, *rng.choices(vocabulary, k=10)])))
    docs += [(500, None), (501, ""), docs[0]]
    d, t = spark.createDataFrame(docs, "k bigint, t string"), spark.createDataFrame([*items, (99, None), (98, "")], "i bigint, t string")
    whole = sorted(map(tuple, op.leaked_passages(d, "k", "t", t, "i", "t").collect()))
    joined = sorted(map(tuple, op.leaked_passages(d, "k", "t", t, "i", "t", block_items=5, map_bits=1 << 12).collect()))
    assert whole == joined and len(whole) > 60
    assert op.leaked_passages(d.filter("false"), "k", "t", t, "i", "t", block_items=5).count() == 0
