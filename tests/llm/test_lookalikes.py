from pyspark.sql import functions as F

from tessera.llm import lookalikes as L

SAME = [
    ("Score", "Sсоre"), ("name", "ｎａｍｅ"), ("é", "é"), ("a b", "a b"), ("a b", "a b"), ("item", "it‍em"), ("find", "ﬁnd"), ("K", "K"),
    ("ガ", "ガ"), ("NR-17", "NR‑17"), ("Вот é", "Bот é"), ("a\r\nb", "a\nb"), ("x", "﻿x "), ("✅", "✅️"), ("2026", "２０２６"), ("й", "й"),
]
APART = [("n", "ñ"), ("a", "A"), ("2", "²"), ("8", "⑧"), ("👩‍💻", "👩💻"), ("⚠️", "⚠"), ("½", "1/2"), ("a b", "ab"), ("ß", "ss"), ("👍", "👍🏽"), ("o", "0")]


def test_visible_form():
    for a, b in SAME:
        assert L.visible_form(a) == L.visible_form(b), (a, b)
        assert L.common_form(a) == L.common_form(b), (a, b)
    for a, b in APART:
        assert L.visible_form(a) != L.visible_form(b), (a, b)


def test_common_form_folds_case():
    assert L.common_form("STRASSE") == L.common_form("straße")


def test_pairs(spark):
    rows = [(1, "Score x"), (2, "Sсоre x"), (3, "score x"), (4, "Score x"), (5, None), (6, "​ "), (7, " "), (8, "Sсоre x"), (1, "Score x")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, common_key string")
    got = {tuple(r) for r in L.look_pairs(df).collect()}
    assert got == {(1, 2), (1, 8), (2, 4), (2, 8), (4, 8)}
    assert L.look_pairs(df.limit(0)).count() == 0


def test_column(spark):
    df = spark.createDataFrame([("Ａ",), (None,)], "t string")
    assert [r.c for r in df.select(L.common_form_of("t").alias("c")).collect()] == ["a", None]


def test_ascii_form_agrees_with_python(spark):
    vs = ["Plain Text", "a\tb \r\n c  \n", "\n x \n", "tab\t", "A\x0bB\x0cC", "  ", "", "x   \ny", "\rq", "I [] {} ^ ~"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v string")
    got = {r.i: r.c for r in df.select("i", L.ascii_common(F.col("v")).alias("c")).collect()}
    assert [got[i] for i in range(len(vs))] == [L.common_form(v) for v in vs]


def test_links_of_classes(spark):
    rows = [(1, "Score x"), (2, "Sсоre x"), (4, "Score x"), (8, "Sсоre x"), (9, "Sсore x"), (10, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.links for r in L.same_look(df).collect()}
    assert got == {1: 3, 4: 3, 2: 3, 8: 3, 9: 4}
    assert L.look_pairs(df).count() == sum(got.values()) // 2
