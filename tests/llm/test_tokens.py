import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from protospan.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    try:
        ranks = tokens._ranks(tokens._load(tokens.rank_file()))
    except OSError:
        pytest.skip("no vocabulary")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, pos string")
    return sorted((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect())


CASES = ["Hello world", "", None, "   ", " a  b   c ", "it's we'll I'D", "<|endoftext|> plain", "日本語 テキスト", "a b　c\x85d", "\n\n x\r\n\ty", "12345 67.8", "👍👍🏽", "\x00﻿​", "x" * 20000, " " * 5000 + "end", "naïve café é", "ZX1;ZX2", "퟿"]


def test_like_the_library(spark, enc):
    got = dict(ids_of(spark, [(i, t, "w", "p") for i, t in enumerate(CASES)]))
    assert got == {i: (enc.encode_ordinary(t) if t else []) for i, t in enumerate(CASES)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"]), max_size=40), min_size=1, max_size=30))
def test_any_text(spark, enc, texts):
    got = dict(ids_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_repeats_and_empty_table(spark, enc):
    a, b = enc.encode_ordinary("same text here"), enc.encode_ordinary("other")
    rows = [(1, "same text here", "", ""), (1, "same text here", "", ""), (1, "same text here", "", ""), (1, "other", "", ""), (None, "other", "", ""), (2, "", "", ""), (2, None, "", "")]
    got = ids_of(spark, [r for r in rows if r[0] is not None])
    assert got == sorted([(1, a)] * 3 + [(1, b), (2, []), (2, [])])
    assert ids_of(spark, []) == []


def test_words_of_very_many_ids(spark, enc, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_IDS", 3)
    texts = ["aaaabbbbqzqzqzxkcd plain words", "plain", "xkcdqqzzyyvvwwkk 123456789012 end qqzzyyvvwwkk"]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(2, texts[2], "", "")]
    assert ids_of(spark, rows) == sorted((i, enc.encode_ordinary(t)) for i, t, _, _ in rows)


def test_round_trip(spark):
    texts = [t for t in CASES if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
