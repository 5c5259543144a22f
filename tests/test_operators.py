"""Operators on small tables with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scorers, sketches
from tessera.operators import blocking, clusters, frames, mapping, matching, quality, relations, stats, survivorship
from tessera.sources import io
from tessera.streaming import matcher


def test_scorers(spark):
    cases = [
        ("jaro_winkler", "MARTHA", "MARHTA", 0.9611), ("jaro_winkler", "abcd", "abxy", 0.6667), ("levenshtein", "kitten", "sitting", 0.5714), ("levenshtein", "", "", 1.0), ("token_sort", "John Smith", "Smith John", 1.0),
        ("damerau", "ab", "ba", 0.5), ("soundex_match", "Robert", "Rupert", 1.0), ("soundex_match", "1", "2", 0.0), ("jaccard", "a b c", "b c d", 0.5), ("dice", "a b", "b c", 0.5), ("qgram:2", "abc", "abd", 0.3333),
        ("date_diff", "2024-01-05", "2024-05-01", 0.8), ("geo_haversine", "48.85,2.35", "48.85,2.36", 0.85), ("numeric_diff:abs:10", "5", "10", 0.5), ("exact", "a", None, 0.0), ("initialism_match", "IBM", "International Business Machines", 1.0), ("ensemble", "Smith John", "John Smith", 1.0),
    ]
    df = spark.createDataFrame([(x, y) for _, x, y, _ in cases], "x string, y string")
    for i, (name, x, y, want) in enumerate(cases):
        got = df.where((F.col("x") == x) & F.col("y").eqNullSafe(F.lit(y))).select(scorers.score(name, F.col("x"), F.col("y")).alias("s")).first().s
        assert round(got, 4) == want, (name, x, y, got)
    with pytest.raises(NotImplementedError):
        scorers.score("nothing", F.lit("a"), F.lit("b"))


def test_optimal_bands_and_minhash(spark):
    assert sketches.optimal_bands(64, 0.8)[0] * sketches.optimal_bands(64, 0.8)[1] == 64
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " tail"), (3, " ".join(f"z{i}" for i in range(60))), (4, None), (5, "")], "id long, t string")
    assert {(r.a, r.b) for r in blocking.minhash(df, "id", "t").collect()} == {(1, 2)}


def test_minhash_recall_against_brute_force(spark):
    rng, rows = random.Random(7), []
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(84)]
        at = rng.randrange(10, 70)
        near = words[:at] + ["changed"] + words[at + 1 :]  # 75 of 85 shingles, 0.88
        far = near[: at // 2] + ["other"] + near[at // 2 + 1 :] + ["tail"] * 3
        rows += [(4 * g, " ".join(words)), (4 * g + 1, " ".join(near)), (4 * g + 2, " ".join(far)), (4 * g + 3, " ".join(words).upper())]
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    df = spark.createDataFrame(rows, "id long, t string")
    got = [(r.a, r.b) for r in blocking.minhash(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want)
    groups = lambda p: {(r.member, r.cluster_id) for r in clusters.components(p).collect()}
    assert groups(blocking.minhash_links(df, "id", "t")) == groups(blocking.minhash(df, "id", "t"))


def test_simhash_recall_and_both_ends(spark, tmp_path):
    import numpy as np

    from tessera.plans import catalogue

    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        u, v = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        rows += [(2 * i, u.tolist()), (2 * i + 1, (0.9 * u + (1 - 0.81) ** 0.5 * v).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = np.array([v for _, v in rows])
    near = {(a, b) for a, b in zip(*np.where(x @ x.T >= 0.8999)) if a < b}
    p = {(r.a, r.b) for r in blocking.simhash(spark.read.parquet(str(tmp_path / "embeddings.parquet")), "vec_id", "embedding", 32, *catalogue.SIMHASH).collect()}
    assert len(near & p) >= 0.9 * len(near)
    want = {i: sum(i in e for e in p) for i in {i for e in p for i in e}}
    assert {r.a: r.candidates for r in catalogue.block_simhash(spark, str(tmp_path)).collect()} == want


def test_blocking(spark):
    df = spark.createDataFrame([(1, "Ann", "x"), (2, "ann ", "y"), (3, "null", "x"), (4, None, "x"), (5, "Bob", "y")], "id long, n string, g string")
    static = {(r.a, r.b) for r in blocking.static(df, "id", [("n", ["strip", "lowercase"])]).collect()}
    assert static == {(1, 2)}
    both = {(r.a, r.b) for r in blocking.multi_pass(df, "id", [[("n", ["strip", "lowercase"])], [("g", [])]]).collect()}
    assert both == {(1, 2), (1, 3), (1, 4), (3, 4), (2, 5)}
    near = {(r.a, r.b) for r in blocking.sorted_neighbourhood(df, "id", F.lower(F.trim("n")), 2).collect()}
    assert near == {(1, 2), (2, 5), (3, 5)}
    ids = [r[blocking.ID] for r in blocking.with_row_id(df, "id").orderBy("id").collect()]
    assert ids == list(range(5))


def test_components_and_comparison(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a long, b long")
    ids = spark.range(400)
    got = {r.member: r.cluster_id for r in clusters.components(df, ids).collect()}
    assert got == {i: find(i) for i in range(400)}
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "member long, cluster_id long")
    b = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3)], "member long, cluster_id long")
    r = clusters.compare(a, b).first()
    assert (r.unchanged, r.merged, r.partitioned) == (0, 2, 1)


def test_split_and_add(spark):
    clique = lambda s, w: [(a, b, w) for a in range(s, s + 4) for b in range(a + 1, s + 4)]
    scored = spark.createDataFrame(clique(0, 0.9) + clique(10, 0.95) + [(3, 10, 0.3)], "a long, b long, score double")
    m = clusters.components(scored)
    parts = clusters.split_oversized(m, scored, 5).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in parts) == [4, 4]
    conf = clusters.confidence(m, scored).first()
    assert conf.quality == "weak" and conf.size == 8
    grown = {r.member: r.cluster_id for r in clusters.add_pairs(m, spark.createDataFrame([(13, 77)], "a long, b long")).collect()}
    assert grown[77] == 0 and len(grown) == 9


def test_survivorship(spark):
    df = spark.createDataFrame(
        [(1, 1, "Al", "x", dt.date(2024, 1, 1), 3.0), (1, 2, "Alan", "y", dt.date(2024, 3, 1), 1.0), (1, 3, "Alex", "y", dt.date(2024, 2, 1), None), (2, 4, None, None, None, None)],
        "c long, r long, n string, s string, d date, v double",
    )
    cols = df.select("*", F.col("n").alias("n2"), F.col("n").alias("n3"), F.col("v").alias("v2"), F.col("s").alias("s2"))
    g = survivorship.golden(cols, "c", "r", {"n": "most_complete", "n2": ("most_recent", {"date": "d"}), "n3": ("source_priority", {"source": "s", "priority": ["y", "x"]}), "v": "numeric_mean", "v2": "numeric_median", "s": "majority_vote", "s2": "unanimous_or_null"})
    r = {x.c: x for x in g.collect()}
    one, two = r[1], r[2]
    assert (one.n, one.n_confidence, one.n2, one.n3, one.v, one.v2, one.s, one.s2) == ("Alan", 0.7, "Alan", "Alan", 2.0, 1.0, "y", None)
    assert two.n is None and two.n_confidence == 0.0 and two.s is None
    w = survivorship.field_group(df, "c", "r", ["n", "v"], "d").where("c = 1").first()
    assert (w.winner, w.n, w.v) == (2, "Alan", 1.0)
    with pytest.raises(NotImplementedError):
        survivorship.golden(df, "c", "r", {"n": "nothing"})


def test_matching_end_to_end(spark):
    df = spark.createDataFrame([(1, "Ann Meyer", "R"), (2, "Ann Meyr", "R"), (3, "Bob Stone", "R"), (4, "Ann Meyer", "S")], "id long, n string, g string")
    res = matching.dedupe(df, "id", [[("g", [])]], [("n", "jaro_winkler", 1.0)], 0.9, {"n": "most_complete"})
    assert [(r.cluster_id, r.n) for r in res.golden.collect()] == [(1, "Ann Meyer")]
    assert res.dupes.count() == 2 and {r.id for r in res.unique.collect()} == {3, 4}
    one = matching.best_one_to_one(spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.1)], "a long, b long, score double"))
    assert {(r.a, r.b) for r in one.collect()} == {(1, 1), (2, 2)}
    e = matching.evaluate_pairs(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"), spark.createDataFrame([(2, 1), (5, 6)], "a long, b long")).first()
    assert (e.tp, e.fp, e.fn, e.f1) == (1, 1, 1, 0.5)


def test_fellegi_sunter(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        match = i % 10 == 0
        rows.append((i, i, *[int(rng.random() < (0.95 if match else 0.1)) for _ in range(3)]))
    lv = spark.createDataFrame(rows, "a long, b long, g0 int, g1 int, g2 int")
    u = [[0.9, 0.1]] * 3
    model = matching.train(lv, [2, 2, 2], u)
    assert abs(model.match_share - 0.1) < 0.03 and all(m[1] > 0.85 for m in model.m)
    s = {(r.g0, r.g1, r.g2): r.s for r in lv.select("g0", "g1", "g2", model.score(3).alias("s")).distinct().collect()}
    assert s[1, 1, 1] == 1.0 and s[0, 0, 0] == 0.0


def test_stats_and_relations(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", None), (4, None, 4.0)], "i long, k string, v double")
    p = {r["column"]: r for r in stats.profile(df).collect()}
    assert (p["k"]["nulls"], p["k"]["distinct"], p["v"]["null_ratio"]) == (1, 3, 0.25)
    h = stats.histogram(df, "v", 3).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 1]
    assert [r.n for r in stats.histogram(df.where("i = 1"), "v", 3).collect()] == [1]
    assert stats.histogram(df.limit(0), "v", 3).count() == 0
    assert stats.chi2_gof([50, 50], [50, 50]) == (0, 1.0) and abs(stats.chi2_gof([60, 40], [50, 50])[1] - 0.0455) < 1e-3
    fd = spark.createDataFrame([(i, i % 5, (i % 5) * 2 % 3) for i in range(60)], "i long, a long, b long")
    assert {(r.determinant, r.dependent) for r in relations.functional_dependencies(fd, ["i", "a", "b"]).collect()} == {("a", "b")}
    assert relations.composite_keys(spark.createDataFrame([(a, b, 1) for a in range(4) for b in range(4)], "a long, b long, c long"), ["a", "b", "c"]) == [("a", "b")]
    assert [(r.gap_start, r.gap_end) for r in relations.sequence_gaps(spark.createDataFrame([(1,), (4,), (2_000_001,), (2_000_002,)], "v long"), "v").orderBy("gap_start").collect()] == [(2, 3), (5, 2_000_000)]


def test_frames(spark):
    df = spark.createDataFrame([(1, " n/a ", "12345"), (2, "x  y", "bad"), (3, None, None)], "i long, a string, z string")
    fixed, log = frames.auto_fix(df)
    assert [r.a for r in fixed.orderBy("i").collect()] == [None, "x y", None]
    assert {r["column"]: r.changed for r in log.collect()} == {"a": 2, "z": 0}
    kept, bad, report = frames.validate(df, [{"column": "z", "rule_type": "format", "params": {"format": "zip5"}, "action": "quarantine"}, {"column": "a", "rule_type": "not_null", "action": "flag"}])
    assert [r.i for r in kept.orderBy("i").collect()] == [1, 3] and bad.first()["__quarantine_reason__"] == "z:format" and kept.columns[-1] == "__vf_a_not_null__"
    assert df.where(frames.predicate("i > 1 and a not in ['q']")).count() == 1
    with pytest.raises(NotImplementedError):
        frames.predicate("__import__('os')")
    assert frames.stride_sample(spark.range(100).withColumnRenamed("id", "i"), 10, "i").count() == 10


def test_quality(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.org" if i else "bad", str(i), None) for i in range(60)], "id long, mail string, num string, nothing string")
    f = {(r["column"], r.check): r for r in quality.scan(df).collect()}
    assert f["nothing", "nullability"].severity == "ERROR" and f["mail", "format_detection"].affected_rows == 1 and f["num", "type_inference"].severity == "WARNING"
    assert quality.health(quality.scan(df)).first().grade in "ABC"


def test_mapping(spark):
    src = [mapping.Field("EmailAddr", "string", ["a@b.org"]), mapping.Field("FNAME", "string"), mapping.Field("zip", "string", ["12345"])]
    dst = [mapping.Field("zip_code", "string", ["54321"]), mapping.Field("email", "string", ["x@y.org"]), mapping.Field("first_name", "string"), mapping.Field("other", "bigint")]
    got = {(a, b) for a, b, _ in mapping.map_schemas(src, dst)}
    assert {("EmailAddr", "email"), ("FNAME", "first_name"), ("zip", "zip_code")} <= got


def test_sources(spark, tmp_path):
    p = tmp_path / "x.psv"
    p.write_text("id|zip|flag|n\n1|01234|true|1.5\n2|99999|false|\n")
    df = io.read(spark, str(p))
    assert dict(io.infer_types(df).dtypes) == {"id": "bigint", "zip": "string", "flag": "boolean", "n": "double"}
    both = io.load_sources(spark, [(df, "a", {}), (df.drop("n"), "b", {"flag": "active"})], ["id"])
    assert sorted(r["__row_id__"] for r in both.collect()) == [0, 1, 2, 3] and both.where("__source__ = 'b' and n is null").count() == 2
    path = io.write(both, str(tmp_path), "run1", "golden")
    assert spark.read.parquet(path).count() == 4
    assert "| id |" in io.report_markdown(df) and io.report_json(df).startswith("[") and "<td>01234</td>" in io.report_html(df)
    with pytest.raises(NotImplementedError):
        io.connect(spark, "nothing", {})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Ann Meyer", "R"), (2, "Ann Meyr", "R"), (3, "Bob", "R"), (4, "Ann Meyer", "R"), (5, "Bob", "S")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "id long, n string, g string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    m = matcher.StreamMatcher(spark, f"file://{tmp_path}/home", "id", [("g", [])], [("n", "jaro_winkler", 1.0)], 0.9)
    for i in range(2):
        m(spark.read.parquet(f"{tmp_path}/in/{i}"), i)
    m(spark.read.parquet(f"{tmp_path}/in/1"), 1)  # delivered again
    got = {r.member: r.cluster_id for r in m.assignments().collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    stream = spark.readStream.schema("id long, n string, g string").parquet(f"{tmp_path}/in/*")
    q = matcher.transform_stream(stream, lambda d: d.withColumn("n", F.lower("n")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_fellegi_sunter_leaves_no_pair_out(spark):
    """Against every pair scored one by one: other first words, no entity, copies of one text, missing values."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words[:12] if i % 3 else words, k=rng.choice([2, 12, 13, 40]))) if i % 19 else rng.choice(["", None]), rng.choice(["en", "de", None]), rng.choice("st"), rng.choice([None, 0, 100, 101, 150])) for i in range(90)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:10])]
    df = spark.createDataFrame(rows, "id long, text string, lang string, source string, n long").repartition(3)
    fields = [("text", "dice", [0.9, 0.5]), ("lang", "exact", [1.0]), ("source", "exact", [1.0]), ("n", "numeric_diff:pct:0.5", [0.9])]
    every = df.select(F.col("id").alias("a")).crossJoin(df.select(F.col("id").alias("b"))).where("a < b")
    lv = matching.levels(matching.attach(every, df, df, "id", ["text", "lang", "source", "n"]), fields)
    model = matching.train(lv, [3, 2, 2, 2])
    want = {(r.a, r.b): r.score for r in lv.select("a", "b", model.score(4).alias("score")).where("score >= 0.5").collect()}
    for rows_of_block in (7, 4000):
        got = matching.link_all(df, "id", fields, 0.5, rows=rows_of_block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == want
    assert any((i, 100 + i) in want for i in range(1, 10))


def test_fellegi_sunter_query_compares_all(spark, tmp_path):
    """No entity and another first word: the blocks left this copy out."""
    t = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "ticket " + t, "en", "s", 200, None), (2, "see " + t, "en", "s", 200, None), (3, "other text", "de", "u", 10, "e"), (4, "nothing alike", "fr", "v", 900, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, entity_id string").write.parquet(str(tmp_path / "documents.parquet"))
    from tessera.plans import catalogue

    assert (1, 2) in {(r.a, r.b) for r in catalogue.fellegi_sunter(spark, str(tmp_path)).collect()}


def test_top_k_fuzzy_joins_no_copies(spark):
    """300 copies of each text: each of the 600 queries gets its k least rows, and no join makes the 180,000 pairs of copies."""
    df = spark.createDataFrame([(i, ["hot bolt", "hot ring"][i % 2]) for i in range(600)], "id long, t string")
    got = matching.top_k_fuzzy(df, df, "id", "t")
    assert {(r.query, r.id, r["rank"]) for r in got.collect()} == {(i, i % 2 + 2 * j, j + 1) for i in range(600) for j in range(3)}
    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.queryExecution().toRdd().count()

    def rows(p):
        while p.nodeName() == "AdaptiveSparkPlan" or p.nodeName().endswith("QueryStage"):
            p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan()
        m = p.metrics().get("numOutputRows")
        own = m.get().value() if m.isDefined() else 0
        c = p.children()
        return max([own] + [rows(c.apply(i)) for i in range(c.size())])

    assert rows(plan) <= 4000  # 1800 a run


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Each pair once, also of an id in several rows, of pairs that share several keys and of hot keys, with no aggregate over pairs."""
    rng = random.Random(4)
    rows = [(rng.randrange(150), rng.choice([*"pqr", "hot", "hot", None]), rng.choice("uv")) for _ in range(260)] + [(None, "p", "u")]
    df = spark.createDataFrame(rows, "id long, g string, h string")
    passes = [[("g", [])], [("h", []), ("g", [])], [("h", [])]]
    keys = {}
    for i, g, h in rows:
        keys.setdefault(i, set()).update(({("g", g), ("gh", g, h)} if g else set()) | {("h", h)})
    ids = sorted(i for i in keys if i is not None)
    for got, kinds in ((blocking.static(df, "id", passes[0]), {"g"}), (blocking.multi_pass(df, "id", passes), {"g", "gh", "h"})):
        want = sorted((a, b) for a in ids for b in ids if a < b and any(k[0] in kinds for k in keys[a] & keys[b]))
        assert sorted((r.a, r.b) for r in got.collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0]
    k = df.select("id", F.col("g").alias("k"))
    assert sorted(map(tuple, blocking.pairs_once(k, part=7).collect())) == sorted(map(tuple, blocking.pairs_of(k).collect()))


def test_split_by_tree_in_one_group(spark, monkeypatch):
    """A large cluster is cut in one group, without rounds over shared tables, into the parts the rounds give."""
    rng = random.Random(8)
    edges = {(rng.randrange(i), i) for i in range(1, 90)} | {tuple(sorted(rng.sample(range(90), 2))) for _ in range(60)} | {(200, 201), (201, 202)}
    scored = spark.createDataFrame([(f"r{a:03}", f"r{b:03}", rng.choice([0.5, 0.7, rng.random()])) for a, b in sorted(edges)], "a string, b string, score double")
    m = clusters.components(scored)
    parts = lambda s: {r.member: r.cluster_id for r in s.collect()}
    rounds = parts(clusters.split_by_tree(m, scored, 20, local_edges=0))

    def never(*a):
        raise AssertionError("rounds over shared tables")

    monkeypatch.setattr(clusters, "spanning_tree", never)
    one = parts(clusters.split_by_tree(m, scored, 20))
    assert one == rounds and len(one) == 93 and one["r202"] == "r200"
    assert max(list(one.values()).count(c) for c in set(one.values())) <= 20
