"""Encoding against the public libraries, and the exact round trip."""

import os
import random

import pyarrow as pa
import pytest

from millrace.llm import byte_bpe as op

PATH = f"{op.TOKENIZERS}/{op.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary")
HARD = [None, "", " ", "\n", "a  b\n c \x1c d  e  ", "it's 's x'll <|endoftext|> 　 \r\n  z", "é" * 3000, "a\x1c b \x85 c", "x" * 5000, "日本語　テスト", "👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def encoder():
    return op.Encoder(op.read_ranks(PATH))


def texts():
    rng = random.Random(7)
    alphabet = ["a", "b", " ", "  ", "\n", "\r", "\xa0", "　", " ", "\x1c", "\x85", "é", "1", "'s", "'", "!", "ß", "日", "​", "\t", "́"]
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def split(encoder, ts):
    flat, ends = encoder.encode(pa.array(ts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_against_libraries(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("tokenizers")
    ts = texts()
    got = split(encoder, ts)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.ranks, special_tokens={})
    assert got == [one.encode_ordinary(t or "") for t in ts]
    two = tokenizers.Tokenizer.from_file(f"{op.TOKENIZERS}/byte_bpe_50k.json")
    two.encode_special_tokens = True
    assert got == [e.ids for e in two.encode_batch([t or "" for t in ts], add_special_tokens=False)]


def test_small_memory_changes_nothing(encoder):
    small = op.Encoder(encoder.ranks, remembered=3)
    ts = texts()[:400]
    assert split(small, ts) == split(encoder, ts)


def test_roundtrip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(HARD)] + [(0, None, None)]
    ids = op.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text")
    assert ids.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert sorted((r.doc_id, r.text) for r in op.decode_ids(ids, "doc_id", "ids").collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert op.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_another_vocabulary_of_the_same_pattern():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    other = op.Encoder(op.read_ranks(f"{op.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    one = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    ts = texts()
    assert split(other, ts) == [one.encode_ordinary(t or "") for t in ts]
