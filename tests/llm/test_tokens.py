import base64
import os

import pytest

from tessera.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
PATH = tokens.VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")

TEXTS = [
    None, "", " ", "  \n\n  x", "Hello world, it's 2024!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve café — ½ 😀👩‍💻", "<|endoftext|> is text",
    "日本語のテキスト" * 200, "don't DON'T we'll  \t tabs\r\n", "x" * 5000 + " " + "ab" * 3000, "\x00\x01 control",
]


def test_against_reference_encoder(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (enc.encode_ordinary(t) if t else []), t
        assert enc.decode(got[i]) == (t or "")
    n = {r.doc_id: r.tokens for r in tokens.token_counts(df, keep=("ids",)).collect()}
    assert n == {i: len(v) for i, v in got.items()}


def test_slices_and_ranges_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"word{i % 7} again and again {i}" if i % 9 else None) for i in range(50)], "doc_id long, text string").repartition(2)
    a = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    monkeypatch.setattr(tokens, "SLICE", 60)
    monkeypatch.setattr(tokens, "WORDS", 5)
    assert a == {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert {k: len(v) for k, v in a.items()} == {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
