import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.catalogue import VOCABULARY
from quern.llm.tokens import Encoder, decode, encode_corpus, read_ranks, states_before
from tests.conftest import rows


@pytest.fixture(scope="module")
def mine():
    return Encoder(read_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_equals_the_library(mine, theirs, texts):
    assert [i for i, _ in mine.encode(texts)] == theirs(texts)


def test_hard_boundaries(mine, theirs):
    r = random.Random(7)
    letters = "aZé'sdmtrelv  \n\t\xa0​　 09½.,!—한д́👍\x85\x1c'"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)]
    texts += ["it's'll", "'re've'm", " 's", "''s", "x  y", "x \n y ", "<|endoftext|>", "a" * 3000, " " * 3000, "'" * 999, "\n" * 50]
    assert [i for i, _ in mine.encode(texts)] == theirs(texts)


def test_scan_over_many_levels(mine, theirs):
    text = "word 12 isn't\n\n " * 20_000
    assert next(iter(mine.encode([text])))[0] == theirs([text])[0]
    assert len(states_before(__import__("numpy").zeros(0, "uint8"))) == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_offsets(mine, text):
    tokens = {v: k for k, v in mine.ranks.items()}
    ids, starts = next(iter(mine.encode([text])))
    assert decode(ids, tokens) == text
    cuts = sorted(set(starts)) + [len(text)]
    for a, b in zip(cuts, cuts[1:]):
        assert decode([i for i, s in zip(ids, starts) if s == a], tokens) == text[a:b]


def test_corpus(spark, theirs):
    texts = [None, "", "Hello world", "Hello world", "x" * 200_000, "​", "naïve 한국어"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r[0]: r[1] for r in encode_corpus(df, VOCABULARY).collect()}
    assert got == dict(enumerate([[], [], *theirs(texts[2:])]))
    assert rows(encode_corpus(df.limit(0), VOCABULARY)) == []
    assert encode_corpus(df, VOCABULARY, offsets=True).where("doc_id = 2").first()["starts"] == [0, 5]
