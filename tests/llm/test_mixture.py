import os

import pytest

from tessera.llm import mixture, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def test_shares_and_caps(spark):
    docs = [(i, "word " * (1 + i % 9), s) for s, n, base in (("a", 300, 0), ("b", 40, 1000), ("c", 5, 2000)) for i in range(base, base + n)] + [(9000, None, "a"), (9001, "", "b"), (9002, "no source", None), (0, "word " * 1, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mix(df, targets, total_tokens=1000)
    rows = chosen.collect()
    caps = {"a": 2, "b": 4, "c": 3}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.repeats <= caps[r.source] and r.tokens > 0 for r in rows)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "none", None}
    for name in ("a", "b"):
        assert abs(s[name].chosen_tokens - 1000 * s[name].target_share) <= 5
    assert s["c"].chosen_tokens == 3 * s["c"].available_tokens  # too small: all of it, as often as allowed
    assert s["none"].chosen_tokens == 0 and s[None].target_share == 0 and s[None].chosen_tokens == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    # repeats of a source differ by one at most: the thresholds are nested
    for name in ("a", "b", "c"):
        assert len({r.repeats for r in rows if r.source == name}) <= 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mix(df, t)
    assert chosen.count() == 0 and [tuple(r)[:2] for r in shares.collect()] == [("a", 1.0)]
