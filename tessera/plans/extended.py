"""More queries of the engine's operators, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scorers
from tessera.functions import transforms as T
from tessera.operators import clusters, frames, identity, matching, ordered, stats, survivorship
from tessera.plans.catalogue import _EDGES, _TRUTH, _edges, _truth
from tessera.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pick(key: str, values: list[str]):
    """(column on demand, SQL): one of the values by a key, the same in both engines."""
    n = len(values)
    sql = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({key} % {n})::int + 1]"
    return lambda: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % n).cast("int") + 1), sql


# ---- transforms ---------------------------------------------------------
@query("""select doc_id, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') s, case when length(text) >= 30 then text else rpad(text, 30, '.') end pr, translate(text, '‘’‚‛“”„‟′″«»', '''''''''\"\"\"\"''\"\"\"') q,
regexp_replace(text, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}\\x{2B50}\\x{2B55}]', '', 'g') e from documents""")
def transform_text_more(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.strip(t).alias("s"), T.pad_right(t, "30", ".").alias("pr"), T.normalize_quotes(t).alias("q"), T.remove_emojis(t).alias("e"))


_PEOPLE = ["Dr. Ann Lee", "prof Bob K. Stone Jr.", "Mary  Ann   Smith", "Liz Meyer, PhD", "Stone, Carla", "Jim", "  Mr. Tom O Hara III ", "Kate"]
_name, _name_sql = pick("c_custkey", _PEOPLE)


@query(f"""with c as (select c_custkey, {_name_sql} n from customer)
select c_custkey, trim(regexp_replace(n, '(?i)^\\s*(?:(?:mr|mrs|ms|miss|mx|dr|prof|sir|madam|rev|hon)\\.?\\s+)+', '')) titles, trim(regexp_replace(n, '(?i)(?:,?\\s+(?:jr|sr|ii|iii|iv|v|phd|md|esq|cpa|dds)\\.?)+\\s*$', '')) suffixes,
case when len(w) > 2 then w[1] || ' ' || w[-1] else n end middle, w[1] as first_name, case when len(w) > 1 then w[-1] else '' end last_name, trim(split_part(n, ',', -1)) rev_first, trim(split_part(n, ',', 1)) rev_last,
regexp_matches(n, '(?:^|\\s)[A-Za-z]\\.?(?:\\s|$)') initial, case lower(trim(n)) when 'jim' then 'James' when 'kate' then 'Katherine' else n end nickname, trim(n) || ' ' || 'X' || c_custkey merged
from (select *, regexp_split_to_array(trim(regexp_replace(n, '\\s+', ' ', 'g')), ' ') w from c)""")
def transform_names_more(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _name().alias("n"), F.concat(F.lit("X"), F.col("c_custkey").cast("string")).alias("other"))
    n, s, r = F.col("n"), T.split_name(F.col("n")), T.split_name_reverse(F.col("n"))
    return c.select("c_custkey", T.strip_titles(n).alias("titles"), T.strip_suffixes(n).alias("suffixes"), T.strip_middle(n).alias("middle"), s["first_name"].alias("first_name"), s["last_name"].alias("last_name"), r["first_name"].alias("rev_first"), r["last_name"].alias("rev_last"), T.initial_expand(n).alias("initial"), T.nickname_standardize(n).alias("nickname"), T.merge_name(n, "other").alias("merged"))


@query("""select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') eu, strftime(o_orderdate, '%Y-%m-%d') parsed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') stamp, true ok, false bad, month(o_orderdate)::int m, day(o_orderdate)::int dd, date_sub('year', o_orderdate::date, date '2025-01-01')::int age from orders""")
def transform_dates_more(spark, d):
    s = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, d, "orders").select("o_orderkey", T.date_eu(s).alias("eu"), T.date_parse(s).alias("parsed"), T.datetime_iso8601(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("stamp"), T.date_validate(s).alias("ok"), T.date_validate(F.concat(F.lit("no date "), s)).alias("bad"), T.extract_month(s).alias("m"), T.extract_day(s).alias("dd"), T.age_from_dob(s, "2025-01-01").alias("age"))


_ROMAN = ["I", "IV", "IX", "XIV", "XL", "XCIX", "CDXLIV", "MCMXCIV", "IIII"]
_ORD = ["first", "3rd", "Twelfth", "21st", "42", "none"]
_roman, _roman_sql = pick("l_linenumber", _ROMAN)
_ord, _ord_sql = pick("l_orderkey", _ORD)


@query(f"""select l_orderkey, l_linenumber, abs(l_discount - 0.05) a, coalesce(case when l_linenumber > 1 then l_tax end, 0.0) z, round(l_quantity, 0)::double cur, round(l_quantity / 100, 6) pct, round(l_quantity + 0.5, 2) com,
round(l_linenumber / 8.0, 6)::double fr, case {_ord_sql} when 'first' then 1 when '3rd' then 3 when 'Twelfth' then 12 when '21st' then 21 when '42' then 42 end ord, case {_roman_sql} when 'I' then 1 when 'IV' then 4 when 'IX' then 9 when 'XIV' then 14 when 'XL' then 40 when 'XCIX' then 99 when 'CDXLIV' then 444 when 'MCMXCIV' then 1994 end rom, (l_quantity * 1000)::double sci from lineitem""")
def transform_numbers_more(spark, d):
    whole = F.col("l_quantity").cast("long").cast("string")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.abs_value(F.col("l_discount") - 0.05).alias("a"), T.fill_zero(F.when(F.col("l_linenumber") > 1, F.col("l_tax"))).alias("z"), T.currency_strip(F.concat(F.lit("$ "), whole)).alias("cur"),
        F.round(T.percentage_normalize(F.concat(whole, F.lit(" %"))), 6).alias("pct"), F.round(T.comma_decimal(F.concat(whole, F.lit(",5"))), 2).alias("com"), F.round(T.fraction_to_decimal(F.concat(F.col("l_linenumber").cast("string"), F.lit("/8"))), 6).alias("fr"),
        T.ordinal_to_int(_ord()).alias("ord"), T.roman_to_int(_roman()).alias("rom"), T.scientific_to_decimal(F.concat(whole, F.lit("e3"))).alias("sci"),
    )


_bool, _bool_sql = pick("o_orderkey", ["Yes", "n", "TRUE", "off", "maybe", " 1 "])
_gender, _gender_sql = pick("o_orderkey", ["male", "F", "Woman", "x", " m "])
_cat, _cat_sql = pick("o_orderkey", ["NYC", "new york", "la", "Boston"])
CITIES = {"New York": ["nyc", "ny"], "Los Angeles": ["la"]}


@query(f"""select o_orderkey, case when lower(trim({_bool_sql})) in ('yes', 'true', '1') then true when lower(trim({_bool_sql})) in ('n', 'off') then false end b,
case when lower(trim({_gender_sql})) in ('male', 'm') then 'M' when lower({_gender_sql}) in ('f', 'woman') then 'F' else {_gender_sql} end g, case lower({_cat_sql}) when 'nyc' then 'New York' when 'new york' then 'New York' when 'la' then 'Los Angeles' else {_cat_sql} end c from orders""")
def transform_categories(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.boolean_normalize(_bool()).alias("b"), T.gender_standardize(_gender()).alias("g"), T.category_standardize(_cat(), CITIES).alias("c"))


_form, _form_sql = pick("c_custkey", [" Inc.", ", LLC", " GmbH", "", " Co., Ltd."])


@query(f"""select c_custkey, ['inc', 'llc', 'gmbh', null, 'ltd'][(c_custkey % 5)::int + 1] legal, 'The North-' || c_custkey || ' Bank' stripped, 'north ' || c_custkey || ' bank' normal, 'N' || (c_custkey::varchar)[1] || 'B' initials from customer where {_form_sql} is not null""")
def transform_companies(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("The North-"), F.col("c_custkey").cast("string"), F.lit(" Bank"), _form()).alias("n"))
    n = F.col("n")
    return c.select("c_custkey", T.company_extract_legal(n).alias("legal"), T.company_strip_legal(n).alias("stripped"), T.company_normalize(n).alias("normal"), T.derive_initialism(n).alias("initials"))


_street, _street_sql = pick("s_suppkey", ["street", "AVENUE", "Blvd", "lane.", "Way"])
_state, _state_sql = pick("s_suppkey", ["new york", "Texas", "CA", "Quebec"])
_unit, _unit_sql = pick("s_suppkey", ["Apt 4", "suite #12", "#7", "unit B", "floor 2"])
_country, _country_sql = pick("s_suppkey", ["USA", "Deutschland", "u.k.", "United Kingdom"])


@query(f"""select s_suppkey, s_suppkey || ' Main ' || ['St', 'Ave', 'Blvd', 'Ln', 'Way'][(s_suppkey % 5)::int + 1] std, s_suppkey || ' Main ' || ['street', 'AVENUE', 'Boulevard', 'Lane', 'Way'][(s_suppkey % 5)::int + 1] long, ['NY', 'TX', 'CA', 'Quebec'][(s_suppkey % 4)::int + 1] abbr,
['new york', 'Texas', 'California', 'Quebec'][(s_suppkey % 4)::int + 1] full_state, ['Unit 4', 'Unit 12', 'Unit 7', 'Unit B', 'floor 2'][(s_suppkey % 5)::int + 1] unit, ['US', 'DE', 'u.k.', 'GB'][(s_suppkey % 4)::int + 1] country, s_suppkey || ' Main St' street, 'Oak Town' city, 'TX' st, '75001' zip from supplier""")
def transform_addresses_more(spark, d):
    k = F.col("s_suppkey").cast("string")
    a = F.concat(k, F.lit(" Main "), _street())
    p = T.split_address(F.concat(k, F.lit(" Main St, Oak Town, TX 75001")))
    exp = T.address_expand(F.concat(k, F.lit(" Main "), F.when(F.col("s_suppkey") % 5 == 3, F.lit("Ln")).otherwise(_street())))
    return table(spark, d, "supplier").select("s_suppkey", T.address_standardize(a).alias("std"), exp.alias("long"), T.state_abbreviate(_state()).alias("abbr"), T.state_expand(_state()).alias("full_state"), T.unit_normalize(_unit()).alias("unit"), T.country_standardize(_country()).alias("country"), p["street"].alias("street"), p["city"].alias("city"), p["state"].alias("st"), p["zip"].alias("zip"))


def _luhn_sql(d: str) -> str:
    return f"(list_sum([case when (length({d}) - i) % 2 = 1 then case when 2 * substr({d}, i::int, 1)::int > 9 then 2 * substr({d}, i::int, 1)::int - 9 else 2 * substr({d}, i::int, 1)::int end else substr({d}, i::int, 1)::int end for i in range(1, length({d}) + 1)]) % 10 = 0)"


def _weights_sql(d: str, w: list[int]) -> str:
    return f"list_sum([substr({d}, i::int, 1)::int * {w}[i::int] for i in range(1, {len(w) + 1})])"


@query(f"""with x as (select o_orderkey, '4' || lpad((o_orderkey * 7919)::varchar, 15, '0') cc, lpad((o_orderkey * 104729)::varchar, 15, '3') imei, '1' || lpad((o_orderkey * 31)::varchar, 9, '0') npi, lpad((o_orderkey * 7)::varchar, 9, '1') nine, lpad((o_orderkey * 13)::varchar, 13, '4') ean, '978' || lpad((o_orderkey * 11)::varchar, 10, '0') isbn from orders)
select o_orderkey, {_luhn_sql("cc")} cc, 'visa' brand, substr(cc, 1, 4) || ' ' || substr(cc, 5, 4) || ' ' || substr(cc, 9, 4) || ' ' || substr(cc, 13, 4) fmt, '************' || substr(cc, 13, 4) mask, {_luhn_sql("imei")} imei, {_luhn_sql("('80840' || npi)")} npi, {_luhn_sql("nine")} luhn,
{_weights_sql("nine", [3, 7, 1] * 3)} % 10 = 0 aba, {_weights_sql("lpad(ean, 14, '0')", [3, 1] * 7)} % 10 = 0 ean, {_weights_sql("isbn", [1, 3] * 6 + [1])} % 10 = 0 isbn, isbn isbn13, substr(nine, 1, 2) || '-' || substr(nine, 3) ein, substr(nine, 1, 3) || '-' || substr(nine, 4, 2) || '-' || substr(nine, 6) ssn, '***-**-' || substr(nine, 6) ssn_mask,
nine[1:3] not in ('000', '666') and nine[1] <> '9' and nine[4:5] <> '00' and nine[6:9] <> '0000' ssn_ok, 'DE' || nine vat, true vat_ok, 'DEUTDEFF' swift, true swift_ok, 'DE44 ' || nine[1:4] || ' ' || nine[5:8] || ' ' || nine[9] iban from x""")
def transform_identifiers(spark, d):
    k = F.col("o_orderkey")
    made = lambda mult, n, fill: F.lpad((k * mult).cast("string"), n, fill)
    x = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("4"), made(7919, 15, "0")).alias("cc"), made(104729, 15, "3").alias("imei"), F.concat(F.lit("1"), made(31, 9, "0")).alias("npi"), made(7, 9, "1").alias("nine"), made(13, 13, "4").alias("ean"), F.concat(F.lit("978"), made(11, 10, "0")).alias("isbn"))
    c = F.col
    return x.select(
        "o_orderkey", T.cc_validate(c("cc")).alias("cc"), T.cc_brand(c("cc")).alias("brand"), T.cc_format(c("cc")).alias("fmt"), T.cc_mask(c("cc")).alias("mask"), T.imei_validate(c("imei")).alias("imei"), T.npi_validate(c("npi")).alias("npi"), T.luhn_validate(c("nine")).alias("luhn"), T.aba_validate(c("nine")).alias("aba"),
        T.ean_validate(c("ean")).alias("ean"), T.isbn_validate(c("isbn")).alias("isbn"), T.isbn_normalize(c("isbn")).alias("isbn13"), T.ein_format(c("nine")).alias("ein"), T.ssn_format(c("nine")).alias("ssn"), T.ssn_mask(c("nine")).alias("ssn_mask"), T.ssn_validate(c("nine")).alias("ssn_ok"),
        T.vat_format(F.concat(F.lit("de "), c("nine"))).alias("vat"), T.vat_validate(F.concat(F.lit("de "), c("nine"))).alias("vat_ok"), T.swift_format(F.lit("deut deff")).alias("swift"), T.swift_validate(F.lit("deutdeff")).alias("swift_ok"), T.iban_format(F.concat(F.lit("de44"), c("nine"))).alias("iban"),
    )


@query("""with i as (select s_suppkey, 'DE' b, lpad((s_suppkey * 37)::varchar, 18, '0') n, '0378' || lpad(s_suppkey::varchar, 4, '0') cu from supplier),
c as (select *, 98 - (n || '131400')::hugeint % 97 ck, list_sum([case when i % 2 = 0 then (2 * substr(cu, i::int, 1)::int) // 10 + (2 * substr(cu, i::int, 1)::int) % 10 else substr(cu, i::int, 1)::int end for i in range(1, 9)]) cs from i)
select s_suppkey, true iban_ok, false iban_bad, true cusip_ok, (10 - cs % 10) % 10 = 9 cusip_nine, upper(cu) cusip from c""")
def transform_bank_ids(spark, d):
    """Account numbers made right by their own check digits, and wrong ones."""
    n, cu = F.lpad((F.col("s_suppkey") * 37).cast("string"), 18, "0"), F.concat(F.lit("0378"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))
    x = table(spark, d, "supplier").select("s_suppkey", n.alias("n"), cu.alias("cu"))
    check = F.lpad((F.lit(98) - F.pmod(F.concat("n", F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)"))).cast("int").cast("string"), 2, "0")
    digit = lambda i: F.substring("cu", i, 1).cast("int")
    total = sum(((2 * digit(i) / 10).cast("int") + (2 * digit(i)) % 10 if i % 2 == 0 else digit(i) for i in range(1, 9)), F.lit(0))
    ok = F.concat("cu", ((10 - total % 10) % 10).cast("string"))
    wrong = F.lpad(((check.cast("int") + 1) % 97 + 1).cast("string"), 2, "0")
    return x.select("s_suppkey", T.iban_validate(F.concat(F.lit("DE"), check, F.col("n"))).alias("iban_ok"), T.iban_validate(F.concat(F.lit("DE"), F.when(wrong == check, F.lit("00")).otherwise(wrong), F.col("n"))).alias("iban_bad"), T.cusip_validate(ok).alias("cusip_ok"), T.cusip_validate(F.concat("cu", F.lit("9"))).alias("cusip_nine"), T.cusip_format(F.col("cu")).alias("cusip"))


@query("""select c_custkey, 'https://www.shop' || c_custkey || '.com/A/b?utm_source=x&id=' || c_custkey n, 'www.shop' || c_custkey || '.com' dom, 'HTTPS://Shop' || c_custkey || '.com/' www, 'http://s.com/p?id=' || c_custkey trk, 'https://shop' || c_custkey || '.com/A/b?id=' || c_custkey canon from customer""")
def transform_urls(spark, d):
    k = F.col("c_custkey").cast("string")
    u = F.concat(F.lit("HTTPS://www.Shop"), k, F.lit(".com/A/b?utm_source=x&id="), k)
    return table(spark, d, "customer").select("c_custkey", T.url_normalize(u).alias("n"), T.url_extract_domain(u).alias("dom"), T.url_strip_www(F.concat(F.lit("HTTPS://www.Shop"), k, F.lit(".com/"))).alias("www"), T.url_strip_tracking(F.concat(F.lit("http://s.com/p?id="), k, F.lit("&utm_medium=mail&gclid=1"))).alias("trk"), T.url_canonical(u).alias("canon"))


@query("""select p_partkey, upper('sku-' || p_partkey || '-a') sku, '****' || right(lpad(p_partkey::varchar, 8, '0'), 4) acct, 'A' || lpad((p_partkey % 100)::varchar, 2, '0') || '.' || '1' icd, p_partkey::varchar mls, '1.5,' || p_partkey latlng from part""")
def transform_domain(spark, d):
    k = F.col("p_partkey").cast("string")
    p = table(spark, d, "part").withColumn("lng", k)
    return p.select("p_partkey", T.sku_normalize(F.concat(F.lit(" sku_"), k, F.lit(". a"))).alias("sku"), T.account_mask(F.lpad(k, 8, "0")).alias("acct"), T.icd10_format(F.concat(F.lit("a"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("1"))).alias("icd"), T.mls_normalize(F.concat(F.lit("mls# "), k)).alias("mls"), T.latlng_pack(F.lit("1.5"), "lng").alias("latlng"))


# ---- scoring ------------------------------------------------------------
@query("""with p as (select n_nationkey k, n_name x, lower(n_name) lx, lower(r_name) ly, n_name || '|' || r_name || ';x' ax, r_name || ',X' ay from nation join region on n_regionkey = r_regionkey),
g as (select *, list_distinct([substr(lx, i::int, 3) for i in range(1, length(lx) - 1)]) gx, list_distinct([substr(ly, i::int, 3) for i in range(1, length(ly) - 1)]) gy from p)
select k, round(len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy)))::double, 6) q, round(len(list_intersect(string_split_regex(lower(ax), '[|;,]'), string_split_regex(lower(ay), '[|;,]'))) / len(list_distinct(string_split_regex(lower(ax), '[|;,]') || string_split_regex(lower(ay), '[|;,]')))::double, 6) arr,
case when km <= 0.1 then 1.0 when km <= 1 then 0.85 when km <= 10 then 0.5 when km <= 100 then 0.2 else 0.0 end::double geo, round(1 - bit_count(xor(k * 7919, k * 104729)) / 64.0, 6)::double ham
from (select *, 2 * 6371.0088 * asin(least(sqrt(pow(sin(radians(k * 0.05) / 2), 2)), 1.0)) km from g)""")
def score_more(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x, y, k = F.col("n_name"), F.col("r_name"), F.col("n_nationkey")
    at = F.concat((k * 0.05).cast("decimal(10,4)").cast("string"), F.lit(",10"))
    return n.select(k.alias("k"), F.round(scorers.qgram(x, y), 6).alias("q"), F.round(scorers.array_intersect(F.concat(x, F.lit("|"), y, F.lit(";x")), F.concat(y, F.lit(",X"))), 6).alias("arr"), scorers.geo_haversine(F.lit("0,10"), at).alias("geo"), F.round(scorers.hamming(k.cast("long") * 7919, k.cast("long") * 104729), 6).alias("ham"))


@query("""with p as (select n_nationkey k, n_name x, lower(r_name) y, r_name yy from nation join region on n_regionkey = r_regionkey),
f as (select k, unnest(['name', 'region', 'none']) field, unnest([(1 - levenshtein(lower(x), y) / greatest(length(x), length(y)))::double, case when lower(x) = lower(yy) then 1.0 else 0.0 end::double, null]) score, unnest([2.0, 1.0, 5.0])::double weight from p)
select k a, field, round(score, 6) score, weight, round(score * weight / 3, 6) share from f""")
def explain_pairs(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    side = lambda a: F.struct(a.alias("name"), a.alias("region"), F.lit(None).cast("string").alias("none"))
    p = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), side(F.lower("n_name")).alias("x"), side(F.lower("r_name")).alias("y"))
    e = matching.explain(p, [("name", "levenshtein", 2.0), ("region", "exact", 1.0), ("none", "exact", 5.0)])
    return e.select("a", "field", F.round("score", 6).alias("score"), "weight", F.round("share", 6).alias("share"))


@query("with v as (select lower(trim(lang)) v from documents where lang is not null), t as (select v, count(*) / (select count(*) from v)::double tf from v group by 1) select v \"value\", round(tf, 6) tf from t")
def term_frequencies(spark, d):
    x = table(spark, d, "documents").select(F.lower(F.trim("lang")).alias("lang"))
    return matching.term_frequencies(x, ["lang"])["lang"].withColumn("tf", F.round("tf", 6))


@query("""select 'lang' "column", round(sum(tf * tf), 6) u from (select count(*) / (select count(*) from documents where lang is not null)::double tf from documents where lang is not null group by lang) union all
select 'source', round(sum(tf * tf), 6) from (select count(*) / (select count(*) from documents where source is not null)::double tf from documents where source is not null group by source)""")
def estimate_u(spark, d):
    return matching.estimate_u(table(spark, d, "documents"), ["lang", "source"]).withColumn("u", F.round("u", 6))


@query("with " + _EDGES + ", " + _TRUTH + ", x as (select t.a is not null mt, case when score >= 0.9 then 2 when score >= 0.6 then 1 else 0 end g from e left join t on e.a = t.a and e.b = t.b)" + """
select g as level, round((n1 + 1e-6) / (sum(n1) over () + 3e-6), 6) m, round((n0 + 1e-6) / (sum(n0) over () + 3e-6), 6) u from (select l g, count(*) filter (where mt) n1, count(*) filter (where not mt) n0 from (select unnest([0, 1, 2]) l) left join x on l = g group by 1)""")
def supervised_model(spark, d):
    e = _edges(spark, d).join(_truth(spark, d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("t")).distinct(), ["a", "b"], "left")
    lv = e.select(F.coalesce("t", F.lit(False)).alias("match"), F.when(F.col("score") >= 0.9, 2).when(F.col("score") >= 0.6, 1).otherwise(0).alias("g0"))
    return matching.model_report(spark, matching.supervised(lv, [3]), ["score"]).select("level", F.round("m", 6).alias("m"), F.round("u", 6).alias("u"))


@query("with " + _EDGES + ", " + _TRUTH + """, p as (select a, b from e where score >= 0.8), n as (select count(p.a) n_a, count(t.a) n_b, count(case when p.a is not null and t.a is not null then 1 end) n_both from p full join t on p.a = t.a and p.b = t.b)
select n_a, n_b, n_both, round((n_a + 1) * (n_b + 1) / (n_both + 1)::double - 1, 4) total, round(least(1.0, (n_a + n_b - n_both) / ((n_a + 1) * (n_b + 1) / (n_both + 1)::double - 1)), 6) recall from n""")
def recall_estimate(spark, d):
    r = matching.recall_estimate(_edges(spark, d).where("score >= 0.8"), _truth(spark, d))
    return r.withColumns({"total": F.round("total", 4), "recall": F.round("recall", 6)})


@query("""with s as (select vec_id q, e.vec_id_ id, list_cosine_similarity(a.embedding::double[], e.v) score from embeddings a, (select vec_id vec_id_, embedding::double[] v from embeddings) e where a.vec_id % 100 = 0)
select q as query, id, round(score, 5) score, rank from (select *, row_number() over (partition by q order by score desc, id)::int rank from s) where rank <= 10""")
def top_k_search(spark, d):
    """Every row whose id is divisible by 100 against all rows."""
    e = table(spark, d, "embeddings")
    return matching.top_k_search(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 5))


# ---- clusters -----------------------------------------------------------
_BY = "c as (select doc_id m, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', '', 'g') p, coalesce(lower(trim(entity_id)), '') t from documents)"


def _clusterings(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("member"), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^0-9a-z]+", "").alias("p"), F.coalesce(F.lower(F.trim("entity_id")), F.lit("")).alias("t"))
    return x.select("member", F.col("p").alias("cluster_id")), x.select("member", F.col("t").alias("cluster_id"))


@query("with " + _BY + """, o as (select p, t, count(*)::double n from c group by 1, 2), np as (select p, sum(n) x from o group by 1), nt as (select t, sum(n) y from o group by 1), s as (select sum(n * (n - 1) / 2) tp, sum(n * n / x) bp, sum(n * n / y) br, sum(n) k from o join np using (p) join nt using (t))
select k::bigint members, round(tp / (select sum(x * (x - 1) / 2) from np), 6) as "precision", round(tp / (select sum(y * (y - 1) / 2) from nt), 6) recall, round(bp / k, 6) bcubed_precision, round(br / k, 6) bcubed_recall from s""")
def evaluate_clusters(spark, d):
    e = clusters.evaluate(*_clusterings(spark, d))
    return e.select("members", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "bcubed_precision", "bcubed_recall")])


@query("with " + _BY + " select n as size, count(*) clusters, sum(n)::bigint records from (select count(*) n from c group by t) group by 1")
def cluster_sizes(spark, d):
    return clusters.size_distribution(_clusterings(spark, d)[1])


@query("with " + _BY + ", n as (select count(*) n from c group by p) select sum(n)::bigint records, sum(case when n > 1 then n end)::bigint matched, count(*) clusters, round(sum(case when n > 1 then n end) / sum(n)::double, 6) match_rate, round(1 - count(*) / sum(n)::double, 6) reduction from n")
def match_rate(spark, d):
    return clusters.match_rate(_clusterings(spark, d)[0]).withColumns({c: F.round(c, 6) for c in ("match_rate", "reduction")})


@query("with " + _EDGES + """, arcs as (select a x, b y from e union all select b, a from e), paths as (select sum(d * (d - 1) / 2)::bigint p from (select count(*) d from arcs group by x)), tri as (select count(*) t from e e1 join e e2 on e1.b = e2.a join e e3 on e3.a = e1.a and e3.b = e2.b)
select 3 * t as closed, p - 3 * t as open, round(3 * t / p::double, 6) rate from paths, tri""")
def transitivity(spark, d):
    return clusters.transitivity(_edges(spark, d)).withColumn("rate", F.round("rate", 6))


@query("with " + _EDGES + """, arcs as (select a x, b y from e union all select b, a from e), w as (select * from e where score < 0.9), tri as (select distinct w.a, w.b from w join arcs p on p.x = w.a join arcs q on q.x = w.b and q.y = p.y)
select w.a, w.b, w.score from w left join tri using (a, b) where tri.a is null""")
def weak_bridges(spark, d):
    e = _edges(spark, d)
    return clusters.bridges(clusters.components(e), e).select("a", "b", "score")


@query("with recursive " + _EDGES + """, arcs as (select a x, b y from e where score >= 0.8 union all select b, a from e where score >= 0.8), r(x, y) as (select x, x from arcs union select r.x, arcs.y from r join arcs on r.y = arcs.x), m as (select x, min(y) c from r group by 1)
select c cluster_id, count(*) - 1 edges from m group by 1""")
def spanning_forest(spark, d):
    """A spanning forest has one edge less than each cluster has members."""
    e = _edges(spark, d).where("score >= 0.8")
    t = clusters.spanning_tree(e)
    return t.join(clusters.components(e), F.col("a") == F.col("member")).groupBy("cluster_id").agg(F.count("*").alias("edges"))


@query("select 150 as largest_allowed, 0 as too_large, 0 as lost from region limit 1")
def split_large_clusters(spark, d):
    """Invariants: no part above the bound, no member lost."""
    e = _edges(spark, d)
    m = clusters.components(e)
    s = clusters.split_by_tree(m, e, 150)
    size = s.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return size.agg(F.lit(150).alias("largest_allowed"), F.count_if(F.col("n") > 150).cast("int").alias("too_large"), F.sum("n").alias("n")).crossJoin(m.agg(F.count("*").alias("all"))).select("largest_allowed", "too_large", (F.col("all") - F.col("n")).cast("int").alias("lost"))


# ---- survivors ----------------------------------------------------------
@query("""select o_custkey, count(*) as size, min(o_totalprice) lo, round(sum(o_totalprice), 4) total, round(sum(o_orderkey * o_shippriority_) / sum(o_shippriority_), 6) wavg, count(o_orderstatus) filled, list_aggregate(list_sort(list(distinct o_orderstatus)), 'string_agg', '; ') statuses,
arg_max(o_orderpriority, (-length(o_orderpriority), -o_orderkey)) shortest, arg_max(o_clerk_, (length(o_clerk_), -o_orderkey)) longest, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end unanimous from (select *, (o_orderkey % 3 + 1)::double o_shippriority_, o_orderpriority || repeat('x', (o_orderkey % 4)::int) o_clerk_ from orders) group by 1""")
def golden_more(spark, d):
    c = F.col
    o = table(spark, d, "orders").withColumns({"lo": c("o_totalprice"), "total": c("o_totalprice"), "wavg": c("o_orderkey"), "w": (c("o_orderkey") % 3 + 1).cast("double"), "filled": c("o_orderstatus"), "statuses": c("o_orderstatus"), "shortest": c("o_orderpriority"), "longest": F.concat("o_orderpriority", F.repeat(F.lit("x"), (c("o_orderkey") % 4).cast("int"))), "unanimous": c("o_orderstatus")})
    g = survivorship.golden(o, "o_custkey", "o_orderkey", {"lo": "numeric_min", "total": "numeric_sum", "wavg": ("numeric_weighted_average", {"weight": "w"}), "filled": "count_non_null", "statuses": "concat_unique", "shortest": "shortest_value", "longest": "longest_value", "unanimous": "unanimous_or_null"})
    return g.select("o_custkey", "size", "lo", F.round("total", 4).alias("total"), F.round("wavg", 6).alias("wavg"), "filled", "statuses", "shortest", "longest", "unanimous")


@query("""with v as (select o_custkey, case lower(x) when 'yes' then true when 'n' then false end b, x, o_orderkey from (select o_custkey, o_orderkey, ['Yes', 'n', 'YES', ' maybe '][(o_orderkey % 4)::int + 1] x from orders)), g as (select o_custkey, b, count(*) n, min(o_orderkey) f from v where b is not null group by 1, 2),
w as (select o_custkey, trim(x) t, count(*) n, min(o_orderkey) f from v group by 1, 2)
select o_custkey, any_value(bb) flag, arg_max(t, (n, -f)) word, round(max(n) / sum(n)::double, 6) rate from w left join (select o_custkey, arg_max(b, (n, -f)) bb from g group by 1) using (o_custkey) group by 1""")
def golden_votes(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in ("Yes", "n", "YES", " maybe ")]), (F.col("o_orderkey") % 4).cast("int") + 1)
    o = table(spark, d, "orders").withColumns({"flag": word, "word": word, "rate": F.trim(word)})
    g = survivorship.golden(o, "o_custkey", "o_orderkey", {"flag": "boolean_normalize", "word": "whitespace_normalize", "rate": "agreement_rate"})
    return g.select("o_custkey", "flag", "word", F.round("rate", 6).alias("rate"))


@query("""with g as (select o_custkey, arg_max(o_orderpriority, (length(o_orderpriority), -o_orderkey)) v from orders group by 1) select o.o_custkey, min(o_orderkey) first_row, count(*) "rows" from orders o join g on g.o_custkey = o.o_custkey and g.v = o.o_orderpriority group by 1""")
def golden_provenance(spark, d):
    o = table(spark, d, "orders")
    gold = survivorship.golden(o, "o_custkey", "o_orderkey", {"o_orderpriority": "most_complete"})
    return survivorship.provenance(o, "o_custkey", "o_orderkey", gold, ["o_orderpriority"]).select("o_custkey", "first_row", "rows")


# ---- identity -----------------------------------------------------------
@query("""select count(*) visible from (select created_at v, case when status = 'retired' then updated_at end vt, timestamptz '2025-07-01 00:00:00+00' t from (select distinct * from identity_nodes)) where v <= t and (vt is null or t < vt)""")
def bitemporal_slice(spark, d):
    n = table(spark, d, "identity_nodes").distinct()
    e = n.select(F.col("created_at").alias("valid_from"), F.when(F.col("status") == "retired", F.col("updated_at")).alias("valid_to"), F.col("created_at").alias("ingested_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
    return identity.as_of(e, "2025-07-01 00:00:00", "2025-07-01 00:00:00").agg(F.count("*").alias("visible"))


@query("select distinct r.source, r.source_pk, lower(trim(entity_id)) entity_id from source_records r where entity_id is not null and trim(entity_id) <> ''")
def crosswalk(spark, d):
    r = table(spark, d, "source_records")
    m = r.where("trim(entity_id) <> ''").select(F.col("record_id").alias("member"), F.lower(F.trim("entity_id")).alias("cluster_id")).distinct()
    return identity.crosswalk(r, m, "source", "source_pk", "record_id")


# ---- frames and quality -------------------------------------------------
@query("""select p_partkey as k, upper(p_brand) p_brand, p_size from part where p_size > 40 and p_brand = 'Brand#11'""")
def frame_edits(spark, d):
    p = frames.rename(table(spark, d, "part"), {"p_partkey": "k"})
    p = frames.filter_compare(frames.filter_compare(p, "p_size", ">", "40"), "p_brand", "=", "Brand#11")
    return frames.drop(p, ["p_name", "p_type", "p_retailprice"]).withColumn("p_brand", T.uppercase(F.col("p_brand")))


@query("""select 'value' "column", round(avg(case when d is null then 1 else 0 end), 6) null_ratio, count(*) "rows" from (select nullif(lower(trim(lang)), '') d from documents)""")
def null_ratio(spark, d):
    x = table(spark, d, "documents").select(F.nullif(F.lower(F.trim("lang")), F.lit("")).alias("value"))
    return stats.profile(x).select("column", F.round("null_ratio", 6).alias("null_ratio"), "rows")


# ---- order --------------------------------------------------------------
@query("""select e.event_id, v.amount from (select event_id, user_id, ts from events where event_type = (select min(event_type) from events)) e asof left join (select user_id, ts, max(value) amount from events where event_type = (select max(event_type) from events) group by 1, 2) v on e.user_id = v.user_id and e.ts >= v.ts""")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    left, right = e.where(F.col("event_type") == lo).select("event_id", "user_id", "ts"), e.where(F.col("event_type") == hi).select("user_id", "ts", F.col("value").alias("amount"))
    return ordered.as_of_join(left, right, "user_id", "ts", ["amount"]).select("event_id", "amount")


@query("select o_orderkey, band from orders join (select s_suppkey band, s_suppkey * 4000.0 lo, s_suppkey * 4000.0 + 5000 hi from supplier) on o_totalprice between lo and hi")
def range_join(spark, d):
    bands = table(spark, d, "supplier").select(F.col("s_suppkey").alias("band"), (F.col("s_suppkey") * 4000.0).alias("lo"), (F.col("s_suppkey") * 4000.0 + 5000).alias("hi"))
    return ordered.range_join(table(spark, d, "orders"), bands, "o_totalprice", "lo", "hi", 5000.0).select("o_orderkey", "band")


@query("select o_orderkey, o_totalprice \"value\", round(o_totalprice - lag(o_totalprice) over (order by o_orderkey), 4) diff from orders")
def consecutive_diff(spark, d):
    return ordered.consecutive_diff(table(spark, d, "orders"), "o_totalprice", "o_orderkey").withColumn("diff", F.round("diff", 4))


@query("select coalesce(min(x - p) >= 0, true) \"ascending\", coalesce(max(x - p) <= 0, true) \"descending\" from (select p_retailprice x, lag(p_retailprice) over (order by p_partkey) p from part)")
def is_sorted(spark, d):
    return ordered.is_sorted(table(spark, d, "part"), "p_retailprice", "p_partkey")


@query("select p_brand, p_size, min(p_partkey) p_partkey from part group by 1, 2")
def unique_rows(spark, d):
    return ordered.unique(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey").select("p_brand", "p_size", "p_partkey")


@query("select p_brand, least(25, count(*))::bigint n from part group by 1")
def stratified_sample(spark, d):
    return ordered.stratified(table(spark, d, "part"), "p_partkey", "p_brand", 25).groupBy("p_brand").agg(F.count("*").alias("n"))


_COLS = ["run_id", "is_current", "source_table"]


@query(" union all ".join(f"""select '{c}' "column", count(*) "keys", count(*) filter (where n > 1) changing from (select count(distinct {c}) + max(({c} is null)::int) n from gm_golden_records where cluster_id is not null group by cluster_id)""" for c in _COLS))
def changing_attributes(spark, d):
    return ordered.versions(table(spark, d, "gm_golden_records"), "cluster_id", _COLS).select("column", "keys", "changing")


@query("""with g as (select date_trunc('month', o_orderdate)::timestamp p, sum(o_totalprice) v from orders group by 1)
select strftime(g.p, '%Y-%m') as "period", round(g.v, 2) "value", round(lag(g.v) over (order by g.p), 2) previous, round(a.v, 2) year_ago, round(sum(g.v) over (order by g.p), 2) running from g left join g a on a.p = g.p - interval 12 month""")
def period_compare(spark, d):
    x = ordered.periods(table(spark, d, "orders"), "o_orderdate", F.sum("o_totalprice"))
    return x.select(F.date_format("period", "yyyy-MM").alias("period"), *[F.round(c, 2).alias(c) for c in ("value", "previous", "year_ago", "running")])


@query("""with c as (select l_quantity::double x, count(*) c from lineitem group by 1), r as (select x, c, sum(c) over (order by x) cum, sum(c) over () n, min(x) over () lo, max(x) over () hi from c)
select max(n)::bigint n, round(max(greatest(abs(cum / n - (x - lo) / (hi - lo)), abs((cum - c) / n - (x - lo) / (hi - lo)))), 6) d from r""")
def ks_uniform(spark, d):
    return ordered.ks_uniform(table(spark, d, "lineitem"), "l_quantity").withColumn("d", F.round("d", 6))


@query("""with p as (select p_partkey id, p_name t, list_distinct([substr(lower(p_name), i::int, 3) for i in range(1, length(p_name) - 1)]) g from part), q as (select * from p where id % 100 = 0),
s as (select q.id as query, p.id, round(1 - levenshtein(q.t, p.t) / greatest(length(q.t), length(p.t)), 6)::double score from q join p on len(list_intersect(q.g, p.g)) > 0)
select * from (select *, row_number() over (partition by query order by score desc, id)::int rank from s) where rank <= 3""")
def top_k_fuzzy(spark, d):
    p = table(spark, d, "part")
    return matching.top_k_fuzzy(p, p.where("p_partkey % 100 = 0"), "p_partkey", "p_name").withColumn("score", F.round("score", 6))


@query("""select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.9""")
def ann_pairs(spark, d):
    e = table(spark, d, "embeddings")
    dim = e.select(F.max(F.size("embedding"))).first()[0] or 1
    return matching.ann_pairs(e, "vec_id", "embedding", dim, 0.9).select("a", "b")
