import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.text import char_tokens, flatten_whitespace, join_paragraphs, word_tokens
from quire.operators.chunking import chunk_documents, region_view, split_regions


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_word_tokens_keep_empties(spark):
    assert one(spark, word_tokens, "") == [""]
    assert one(spark, word_tokens, "a  b ") == ["a", "", "b", ""]


def test_char_tokens(spark):
    assert one(spark, char_tokens, "a b") == ["a", "", "", "b"]
    assert one(spark, char_tokens, " a") == ["", "", "a"]
    assert one(spark, char_tokens, " ") == ["", ""]
    assert one(spark, char_tokens, "") == [""]
    for s in ["a b", " a", "héllo wörld", "x😀y z"]:
        assert one(spark, char_tokens, s) == " ".join(s).split(" ")


def test_flatten_and_join(spark):
    assert one(spark, flatten_whitespace, "a\r\nb\nc\td\re") == "a b c d e"
    assert one(spark, join_paragraphs, ["p1", "p2 x"], "array<string>") == "p1 p2 x"


def _chunks(spark, text, n=3, max_tokens=400, unit="word"):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunk_documents(df, "text", n, max_tokens, unit).orderBy("region", "sub").collect()
    return [(r.region, r.sub, r.chunk) for r in rows]


def test_chunk_sizes(spark):
    for n_tok, sizes in [(400, [400]), (401, [201, 200]), (800, [267, 267, 266]), (801, [267, 267, 267])]:
        text = " ".join(f"w{i}" for i in range(n_tok))
        got = [len(c.split(" ")) for _, _, c in _chunks(spark, text, n=1)]
        assert got == sizes, n_tok


def test_fewer_tokens_than_regions(spark):
    assert _chunks(spark, "a") == [(0, 0, "a"), (1, 0, ""), (2, 0, "")]


def reference_chunks(text, n, max_tokens):
    toks = " ".join(text).split(" ") if isinstance(text, list) else text.split(" ")
    out = []
    for i, region in enumerate(np.array_split(np.array(toks, dtype=object), n)):
        parts = np.array_split(region, len(region) // max_tokens + 1) if len(region) > max_tokens else [region]
        out += [(i, j, " ".join(p.tolist())) for j, p in enumerate(parts)]
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "", "c"]), min_size=0, max_size=60), st.integers(1, 4), st.integers(2, 9))
def test_chunks_match_array_split(spark, words, n, max_tokens):
    text = " ".join(words)
    assert _chunks(spark, text, n, max_tokens) == reference_chunks(text, n, max_tokens)


def test_chunks_rejoin_and_bounds(spark):
    text = " ".join(f"t{i}" for i in range(2000))
    ch = _chunks(spark, text)
    assert " ".join(c for _, _, c in ch) == text
    assert max(len(c.split(" ")) for _, _, c in ch) <= 400
    lens = {}
    for r, _, c in ch:
        lens[r] = lens.get(r, 0) + len(c.split(" "))
    assert max(lens.values()) - min(lens.values()) <= 1


def test_char_unit_and_paragraphs(spark):
    assert [c for _, _, c in _chunks(spark, "ab", n=1, unit="char")] == ["a b"]
    df = spark.createDataFrame([(1, ["x y", "z"])], "doc_id long, text array<string>")
    rows = chunk_documents(df, "text", 1, 400, "paragraphs").collect()
    assert rows[0].chunk == "x y z"


def test_region_view_and_split_regions(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 900))], "doc_id long, text string")
    regions = split_regions(df, "text", 3)
    assert regions.count() == 3
    assert region_view(chunk_documents(df), 2).count() == 1
