import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tessera import session
from tessera.llm import batches, linkage, people

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(30)]
ROWS = [
    (1, "crm_contacts", {"first_name": "Ann", "last_name": "Meyer", "email": "ann.meyer1@x.example", "phone": "+1 555 123 4567", "address": "12 Long Street", "city": "Rome", "zip": "12345", "birth_date": "1980-02-05"}),
    (2, "paper_forms", {"applicant": "ANN MEYER", "telephone": "555.123.4567", "residence": "12 Long St., Rome, XD 12345", "birthdate": "05/02/1980"}),
    (3, "clinic_registry", {"patient": "Meyer, A.", "date_of_birth": "05 Feb 1980", "contact": {"email": "Ann.Meyer1@X.example"}, "address": {"line1": None}}),
    (4, "web_signups", {"name": "Ann Meyr", "mail": None, "mobile": "5551234567", "zip": "00000", "born": "05.02.1980"}),
    (5, "event_leads", {"contact_name": "Ann Meyer", "contact_email": "ann.meyer1@x.example", "city": "Rome"}),
    (6, "crm_contacts", {"first_name": "Paul", "last_name": "Meyer", "phone": "5551234567", "address": "12 Long Street", "zip": "12345", "birth_date": "1979-07-30"}),  # a relative
    (7, "loyalty_cards", {"surname": "Meyer", "given": "Ann", "birth": 19510909, "phone_no": "0000000000"}),  # a namesake
    (8, "crm_contacts", {"first_name": "Ann", "last_name": "Meyer", "email": "n/a", "phone": "5551234567", "birth_date": "1980-05-02"}),  # day and month swapped
    (12, "loyalty_cards", {"surname": "Meyer", "given": "Bertha", "birth": 19800205, "phone_no": "5551234567", "addr_line": "12 Long St, Rome, 12345"}),  # a twin
    (13, "paper_forms", {"applicant": "Zoe Quint", "birthdate": "24/12/1950"}),  # shows that this feed writes the day first
    (9, "partner_feed", None),
    (10, "partner_feed", {}),
]


def records(spark):
    rows = [(i, s, json.dumps(p) if p is not None else None, T[i]) for i, s, p in ROWS]
    rows.append((11, "billing_accounts", '{"full_name": "Meyer Ann", "email_addr": "ann.meyer1@x.example", "tel": "(555) 12', T[11]))
    rows.append(rows[0])
    return spark.createDataFrame(rows, "row_id long, source string, payload string, first_seen_at timestamp").withColumn("node", F.lit("clash"))


def test_profiles(spark):
    p = {r.row_id: r for r in people.profiles(records(spark), "row_id", "source").collect()}
    assert (p[2].n1, p[2].n2, p[2].phone, p[2].dob, p[2].zip, p[2].city, p[2].addr) == ("ann", "meyer", "5551234567", "19800205", "12345", "rome", "12 long")
    assert (p[3].n1, p[3].n2, p[3].dob, p[3].email) == ("a.", "meyer", "19800205", "ann.meyer1@x.example")
    assert p[4].zip is None and p[7].phone is None and p[7].dob == "19510909"
    assert (p[11].n1, p[11].email, p[11].phone) == ("meyer", "ann.meyer1@x.example", None)
    assert p[9].n1 is None and p[10].dob is None


def test_pairs_across_feeds(spark):
    rows = linkage.matched_pairs(records(spark), confidence=True).collect()
    got = {(r.row_id_a, r.row_id_b) for r in rows}
    one = [1, 2, 3, 4, 5, 8, 11]  # 11 is cut off and holds its name the other way round
    feed = {i: s for i, s, _ in ROWS} | {11: "billing_accounts"}
    assert got == {(a, b) for a in one for b in one if a < b and feed[a] != feed[b]}
    assert all(0 < r.confidence < 1 for r in rows)
    assert linkage.matched_pairs(records(spark).limit(0)).count() == 0


def test_large_blocks_lose_nothing(spark):
    feeds = ["crm_contacts", "partner_feed"]
    rows = []
    for i in range(160):  # one hot person with many spellings
        p = {"first_name": "Annabella"[: 6 + i % 4], "last_name": "Meyerholt" if i % 3 else "Meyerhlot", "email": "a.m@x.example", "birth_date": "1980-02-05" if i % 5 else None}
        q = {"FNAME": p["first_name"], "LNAME": p["last_name"], "EMAIL1": p["email"], "DOB": p["birth_date"], "ADDR1": f"{i} Long Street"}
        rows.append((i, feeds[i % 2], json.dumps(q if i % 2 else p)))
    df = spark.createDataFrame(rows, "row_id long, source string, payload string")
    assert linkage.matched_pairs(df).count() == 80 * 80


def test_strangers_in_a_shared_mailbox_hide_nobody(spark):
    """Two spellings of one person meet although over 40 others share all their keys."""
    code = [[i, j, (i + j) % 11, (i + 2 * j) % 11] for i in range(11) for j in range(11)][::2]
    tail = lambda c, n: "".join("bcdfghjkmpv"[x] for x in c[:n])
    people = [("And" + tail(c, 4), "Kel" + tail(c[::-1], 3), f"{1930 + i}-0{1 + i % 9}-1{i % 10}") for i, c in enumerate(code)]
    people += [("Andreas", "Keller", "1999-05-25"), ("Andrees", "Kellar", None)]
    pay = [json.dumps({"first_name": f, "last_name": n, "email": "office@x.example", "birth_date": d}) for f, n, d in people]
    last = len(pay) - 1
    rows = [(i, "crm_contacts", p, T[0]) for i, p in enumerate(pay)]
    schema = "row_id long, source string, payload string, first_seen_at timestamp"
    assert last in {r.row_id for r in batches.turned_away(spark.createDataFrame(rows, schema), daily=0).collect()}
    f, n, d = people[-1]
    rows[-1] = (last, "partner_feed", json.dumps({"FNAME": f, "LNAME": n, "EMAIL1": "office@x.example", "DOB": d}), T[0])
    got = {(r.row_id_a, r.row_id_b) for r in linkage.matched_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(last - 1, last)}


def test_turned_away(spark):
    df = records(spark)
    assert {r.row_id for r in batches.turned_away(df, daily=0).collect()} == {8}
    more = [(20, "crm_contacts", json.dumps(ROWS[0][2] | {"last_name": "Mayer", "phone": "?"}), T[0]), (21, "crm_contacts", json.dumps(ROWS[0][2]), T[1]), (22, "crm_contacts", None, T[20]), (23, "crm_contacts", None, T[21])]
    both = df.unionByName(spark.createDataFrame(more, "row_id long, source string, payload string, first_seen_at timestamp"), allowMissingColumns=True)
    # 20 came first; 1, 8 and 21 repeat it (21 at the time of 1, with the larger row_id)
    assert {r.row_id for r in batches.turned_away(both).collect()} == {1, 8, 21}
    assert batches.turned_away(df.limit(0), daily=0).count() == 0


def gate_rows(spark):
    names = [("Anna", "Meyer"), ("Boris", "Kowal"), ("Carla", "Dunst"), ("Dora", "Elmsworth")]
    rows = []
    for i in range(60):
        f, n = names[i % 4]
        n = n if i % 7 else n[:-1] + n[-1] * 2
        rows.append((i, "crm_contacts", json.dumps({"first_name": f, "last_name": n, "email": f"{f}@x.example", "birth_date": "1980-02-0" + str(1 + i % 4)}), T[i // 4]))
    # two profiles of one person that share nothing but the name, until a third shows both contacts
    p = {"first_name": "Eva", "last_name": "Falkner", "birth_date": "1970-01-01"}
    late = [(100, p | {"email": "eva@x.example"}, 1), (101, p | {"last_name": "Falkners", "birth_date": "1970-01-31", "phone": "5557654321"}, 3), (102, {"first_name": "Eva", "last_name": "Falkner", "birth_date": "1970-01-31", "email": "eva@x.example", "phone": "5557654321"}, 9)]
    rows += [(i, "crm_contacts", json.dumps(q), T[t]) for i, q, t in late]
    return spark.createDataFrame(rows, "row_id long, source string, payload string, first_seen_at timestamp")


def test_gate_over_batches_and_restarts(spark):
    """Every batch by a gate opened anew on the folder: the same answer as all at once."""
    df = gate_rows(spark)
    whole = {r.row_id for r in batches.turned_away(df, daily=0).collect()}
    assert len(whole) == 58 and 101 in whole
    home = session.new_path(spark, "gate")
    got, late = set(), set()
    for lo, hi in ((0, 3), (3, 4), (4, 5), (5, 15)):
        out = batches.Gate(spark, home).screen(df.where((F.col("first_seen_at") >= T[lo]) & (F.col("first_seen_at") < T[hi]))).collect()
        got |= {r.row_id for r in out}
        late |= {r.row_id for r in out if r.late}
        assert {r.source for r in out} <= {"crm_contacts"}
    assert got == whole
    assert late == {101}  # known to be a repeat only when 102 came
    gate = batches.Gate(spark, home)
    assert gate.batches == 4
    nodes = gate.read("nodes", batches.NODES)
    assert nodes.count() == nodes.select("node").distinct().count()
    # a run that died before its commit leaves nothing behind that counts
    gate._fs.delete(gate._path(f"{home}/commit/3"), True)
    again = batches.Gate(spark, home)
    assert again.batches == 3
    assert {r.row_id for r in again.screen(df.where(F.col("first_seen_at") >= T[5])).collect()} == {r.row_id for r in out}


def test_gate_reads_what_it_hits(spark):
    home = session.new_path(spark, "gate")
    batches.Gate(spark, home).screen(gate_rows(spark))
    gate = batches.Gate(spark, home)
    hit = spark.createDataFrame([(3,), (5,)], "r int")
    assert {r.r for r in gate.read("segments", batches.SEGMENTS, hit).select("r").distinct().collect()} <= {3, 5}
    assert gate.read("segments", batches.SEGMENTS, hit.limit(0)).count() == 0


def test_dates_by_feed(spark):
    """The order of day and month is read off each feed's own dates."""
    rows = [(1, "a", "25/12/1980"), (2, "a", "05/02/1980"), (3, "b", "12/25/1980"), (4, "b", "05/02/1980"), (5, "c", "05/02/1980"), (6, None, "30/01/1980"), (7, None, "05/02/1980")]
    df = spark.createDataFrame([(i, s, json.dumps({"name": "Ann Lee", "dob": d})) for i, s, d in rows], "row_id long, source string, payload string")
    got = {r.row_id: r.dob for r in people.profiles(df, "row_id", "source").collect()}
    assert got == {1: "19801225", 2: "19800205", 3: "19801225", 4: "19800502", 5: "19800502", 6: "19800130", 7: "19800205"}


def test_entities_are_linear(spark):
    links, members = linkage.entities(records(spark))
    m = {r.row_id: r.entity for r in members.collect()}
    assert {i for i, e in m.items() if e == m[1]} == {1, 2, 3, 4, 5, 8, 11}
    assert all(0 < r.confidence < 1 and r.node_a < r.node_b for r in links.collect())


def test_strangers_at_one_mailbox(spark):
    """Misspelt and slipped records meet whatever the number of others at their mailbox."""
    people_ = [("Mabelina", "Ketovarin"), ("Marcusto", "Kelborne"), ("Maximilda", "Kesterling"), ("Madoka", "Kepplinger"), ("Martinho", "Kenworthy")]
    for others in (10, 90):
        rows = []
        for i, (f, n) in enumerate(people_):
            rows += [(2 * i, "crm_contacts", json.dumps({"first_name": f, "last_name": n, "email": "desk@x.example", "birth_date": f"19{50 + 3 * i}-03-07"})),
                     (2 * i + 1, "partner_feed", json.dumps({"FNAME": f, "LNAME": n[:-1], "EMAIL1": "desk@x.example", "DOB": f"19{50 + 3 * i}-03-17"}))]
        rows += [(100 + j, "crm_contacts", json.dumps({"first_name": "Ma" + chr(97 + j % 26) * 3 + chr(97 + j // 26) * 4, "last_name": "Ke" + chr(97 + j // 26) * 4 + chr(97 + j % 26) * 3, "email": "desk@x.example", "birth_date": f"{1900 + j % 40}-{1 + j % 12:02}-{11 + j % 17}"})) for j in range(others)]
        got = {tuple(r) for r in linkage.matched_pairs(spark.createDataFrame(rows, "row_id long, source string, payload string")).collect()}
        assert got == {(2 * i, 2 * i + 1) for i in range(5)}, others


def test_segments_meet_within_the_bound(spark):
    """Every two strings within the bound share a key (the pigeonhole of the index)."""
    import itertools
    import random

    rng = random.Random(3)

    def edit(s, k):
        for _ in range(k):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abc") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i + 1 :]])
        return s

    for bound in (1, 2):
        texts = list({edit(b, rng.randrange(bound + 1)) for b in ("abcabcab", "ccbbaaccb", "abab", "bcbcbcbcbcbcb") for _ in range(12)} - {""})
        df = spark.createDataFrame([(i, 1, 5, 1, t, bound) for i, t in enumerate(texts)], "node long, bit int, scope long, kind int, text string, bound int")
        own, asked = {}, {}
        for of, to in ((batches.stored, own), (batches.probes, asked)):
            for r in of(df, (1, 2)).collect():
                to.setdefault(r.node, set()).add(r.k)

        def dist(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                prev, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            return row[-1]

        near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if dist(texts[i], texts[j]) <= bound]
        assert near and all(own[i] & asked[j] and own[j] & asked[i] for i, j in near)


def test_keys_of_the_index_are_compiled(spark):
    """No lambda and no generator over an expression: Spark interprets both for every row."""
    rec = people.profiles(gate_rows(spark), "row_id", "source").withColumnRenamed("row_id", "node")
    marks = batches.scopes(rec)
    texts = batches.strings(marks.join(rec.select("node", "n1", "n2", "dob"), "node"))
    for df in (marks, texts, batches.stored(texts), batches.probes(texts)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan
        assert plan.count("Generate explode(") == plan.count("Generate explode(__items#") > 0


def test_hot_scopes_meet_in_parts(spark):
    rows = [(i, 1, s << 32, 1, "ketovar" + "abc"[i % 3], 1) for i in range(12) for s in (5, 6)]
    df = spark.createDataFrame(rows, "node long, bit int, scope long, kind int, text string, bound int")
    asked, own = batches.probes(df), batches.stored(df)
    hot = spark.createDataFrame([(5, 3, o) for o in range(3)], "tag long, n int, o int")
    for h in (hot, hot.limit(0)):
        got = [tuple(r) for r in batches.meet(asked, own, h).collect()]
        assert sorted(got) == [(a, b, 1) for a in range(12) for b in range(a + 1, 12)]


def test_namesakes_and_strangers_of_one_day_make_no_edges(spark):
    """Pairs that grow with the square of the table and cannot link anyone are no edges."""
    rng = random.Random(5)
    tail = lambda: "".join(rng.choice("bcdfghjkmpv") for _ in range(7))
    people_ = [("Ann", "Meyer", f"19{10 + i}-{1 + i % 12:02}-{10 + i % 18}") for i in range(30)]
    people_ += [("An" + tail(), "Ke" + tail(), "1950-03-07") for _ in range(30)]
    pay = [json.dumps({"first_name": f, "last_name": n, "birth_date": d}) for f, n, d in people_]
    df = spark.createDataFrame([(i, "crm_contacts", p) for i, p in enumerate(pay)], "row_id long, source string, payload string")
    nodes = people.profiles(df, "row_id", "source").withColumnRenamed("row_id", "node")
    rows = linkage.key_rows(nodes)
    for block in (40, 8):
        edges, load = linkage.candidate_graph(rows, nodes, block)
        assert edges.count() == 0
        assert {r.x: r.weak for r in load.collect()}[0] == 29
    assert linkage.namesakes(rows).count() == 30
    # a birth date a slip apart still counts
    more = df.unionByName(spark.createDataFrame([(100, "partner_feed", json.dumps({"FNAME": "Ann", "LNAME": "Meyer", "DOB": "1910-01-12"}))], df.schema))
    assert {(r.row_id_a, r.row_id_b) for r in linkage.matched_pairs(more).collect()} == {(0, 100)}


def test_namesakes_forbid_a_merge(spark):
    """The third shares no key but the name with the second: their birth dates are looked up before the merge."""
    ann = {"first_name": "Annabella", "last_name": "Meyerholt"}
    rows = [(1, "crm_contacts", ann | {"email": "a@x.example", "phone": "5551234567", "zip": "12345"}), (2, "loyalty_cards", {"given": "Annabella", "surname": "Meyerholt", "email": "a@x.example", "phone_no": "5551234567", "birth": 19380506}),
            (3, "partner_feed", {"FNAME": "Annabella", "LNAME": "Meyerholt", "DOB": "1999-09-19", "ZIP": "12345"})]
    df = spark.createDataFrame([(i, s, json.dumps(p)) for i, s, p in rows], "row_id long, source string, payload string")
    assert {(r.row_id_a, r.row_id_b) for r in linkage.matched_pairs(df).collect()} == {(1, 2)}
