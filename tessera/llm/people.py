"""Person profiles out of feed payloads, and the score of two profiles.

Shared by the linkage of records across feeds and by the check of new batches
against history. All of it is built-in expressions, so it stays in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.survivors import FIELDS, STAND_INS
from tessera.session import cut

#: Latin letters with marks and their base letter, by rule.
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()}
_FROM, _TO = "".join(_MARKED), "".join(_MARKED.values())
ATTRIBUTES = ["n1", "n2", "email", "phone", "dob", "addr", "zip", "city"]


def _clean(c: Column, stand_ins=STAND_INS) -> Column:
    v = F.lower(F.trim(c, F.lit(" \t\r\n")))
    v = F.when(v.contains("  ") | v.contains("\t") | v.contains("\n"), F.regexp_replace(v, r"\s+", " ")).otherwise(v)
    return F.when(~v.isin(*sorted(stand_ins)), v)


def _fold(c: Column) -> Column:
    return F.when(F.length(c) != F.octet_length(c), F.translate(c, _FROM, _TO)).otherwise(c)


def profiles(records: DataFrame, *keep: str, fields: dict = FIELDS, stand_ins=STAND_INS) -> DataFrame:
    """``keep`` columns and the attributes n1, n2 (first and last name token),
    email, phone (10 digits), dob (yyyymmdd), addr (house number and street
    word), zip, city; absent, blank and stand-in values are null. Cut-off
    payloads give the values that are still whole; null payloads give nulls.

    ``fields`` names the payload keys of each attribute, in lower or upper case,
    ``stand_ins`` the values that stand in for a missing one; both are parameters.
    Whether a feed writes the day or the month first is read off its own dates: what
    is above 12 is a day; a feed without such a date writes the month first.

    The parsed values are written: filters on them must not be pushed into the
    parsing expressions, which they would multiply."""
    return profiles_and_dates(records, *keep, fields=fields, stand_ins=stand_ins)[0]


def profiles_and_dates(records: DataFrame, *keep: str, fields: dict = FIELDS, stand_ins=STAND_INS, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles and what is known of the feeds' dates; ``before`` is what earlier batches showed."""
    r = cut(_parsed(records, keep, fields, stand_ins))
    order = cut(date_order(r, before))
    two = F.split("slash", "/")
    day_first = F.col("first") > F.col("second")
    day, month = F.when(day_first, two[0]).otherwise(two[1]), F.when(day_first, two[1]).otherwise(two[0])
    dob = F.when(F.col("slash").isNotNull(), F.concat(two[2], month, day)).otherwise(F.col("dob"))
    out = r.join(order, F.coalesce("source", F.lit("")) == F.col("feed"), "left")
    dob = F.when((F.length(dob) == 8) & (dob != "19000101") & dob.try_cast("int").isNotNull(), dob)
    return out.select(*keep, *([] if "source" in keep else ["source"]), "n1", "n2", "email", "phone", dob.alias("dob"), "addr", "zip", "city"), order


def date_order(parsed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """feed, first, second: how many of a feed's dates with slashes have a day in the first or second place."""
    two = F.split("slash", "/")
    seen = parsed.where(F.length(two[2]) == 4).groupBy(F.coalesce("source", F.lit("")).alias("feed")).agg(F.count_if(two[0] > "12").alias("first"), F.count_if(two[1] > "12").alias("second"))
    return seen if before is None else seen.unionByName(before).groupBy("feed").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


def _parsed(records: DataFrame, keep: tuple, fields: dict, stand_ins) -> DataFrame:
    """The attributes of :func:`profiles`; of a date with slashes its parts, two digits each, as ``slash``."""
    raw = F.col("payload")
    r = records.select(*keep, *([] if "source" in keep else ["source"]), "payload", F.from_json(raw, "map<string,string>").alias("m"))
    broken = F.col("m").isNull() | (F.size("m") <= 0)

    def get(field: str) -> Column:
        names = [v for k in fields[field] for v in (k, k.upper())]
        found = F.coalesce(*[F.col("m")[k] for k in names])
        nested = {"email": ("contact", "email"), "phone": ("contact", "phone"), "address": ("address", "line1"), "city": ("address", "city"), "zip": ("address", "zip")}.get(field)
        if nested:
            inner = F.get_json_object(F.col("m")[nested[0]], f"$.{nested[1]}")
            is_object = F.col("m")[nested[0]].startswith("{")
            found = F.when(is_object, inner).otherwise(found)
        cut_off = F.regexp_extract(raw, rf'"(?i:{"|".join(fields[field])})"\s*:\s*"?([^"{{}},]*)"?\s*[,}}]', 1)
        return F.when(broken, F.when(cut_off != "", cut_off)).otherwise(found)

    # one step a layer: a layer that is used more than once is not inlined again
    r = r.select(*keep, "source", *[get(f).alias(f) for f in fields if f != "state"])
    r = r.select(*keep, "source", *[_clean(F.col(f), stand_ins).alias(f) for f in fields if f != "state"])
    full = F.col("full_name")
    turned = F.when(full.contains(","), F.concat_ws(" ", F.trim(F.substring_index(full, ",", -1)), F.trim(F.substring_index(full, ",", 1)))).otherwise(full)
    whole = F.trim(_fold(F.coalesce(turned, F.concat_ws(" ", F.col("first_name"), F.col("last_name")))))
    r = r.select("*", whole.alias("whole"), _fold(F.col("address")).alias("line"), F.right(F.regexp_replace("phone", r"\D", ""), F.lit(10)).alias("ten"))
    # middle initials go, wherever the feed puts them
    spaces = F.length("whole") - F.length(F.replace(F.col("whole"), F.lit(" "), F.lit("")))
    r = r.withColumn("whole", F.when(spaces >= 2, F.regexp_replace("whole", r"(?<=\S) (?:[a-z]\.? )+(?=\S)", " ")).otherwise(F.col("whole")))
    whole, one, surname_only = F.col("whole"), ~F.col("whole").contains(" "), F.col("first_name").isNull() & F.col("full_name").isNull()
    n1 = F.when(whole != "", F.when(one, F.when(~surname_only, whole)).otherwise(F.substring_index(whole, " ", 1)))
    n2 = F.when(whole != "", F.when(one, F.when(surname_only, whole)).otherwise(F.substring_index(whole, " ", -1)))
    phone = F.when((F.length("ten") == 10) & ~F.col("ten").isin(*[str(x) * 10 for x in range(10)]), F.col("ten"))
    d, at = F.col("birth_date"), lambda i, n: F.substring("birth_date", i, n)
    part = lambda sep, i: F.lpad(F.split_part(d, F.lit(sep), F.lit(i)), 2, "0")
    month = F.lpad(((F.position(F.substring(F.split_part(d, F.lit(" "), F.lit(2)), 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int").cast("string"), 2, "0")
    slash = d.contains("/")
    dob = (
        F.when((at(5, 1) == "-") & (at(8, 1) == "-"), F.concat(at(1, 4), at(6, 2), at(9, 2)))
        .when(F.length(d) == 8, F.when(~slash, d))
        .when((at(3, 1) == ".") & (at(6, 1) == "."), F.concat(at(7, 4), at(4, 2), at(1, 2)))
        .when(~slash & d.contains(" "), F.concat(F.split_part(d, F.lit(" "), F.lit(3)), month, part(" ", 1)))
    )
    has_comma = F.col("line").contains(",")
    house = r"^\W*(\d+)\s*([a-z]+)"
    number, street = F.regexp_extract("line", house, 1), F.regexp_extract("line", house, 2)
    tail = F.when(has_comma, F.regexp_extract(F.right(F.col("line"), F.lit(10)), r"(?:^|\D)(\d{5})(?:-\d{4})?$", 1))
    zip_ = F.when(F.col("zip").isNotNull(), F.regexp_extract("zip", r"^(\d{5})(?:\D|$)", 1)).otherwise(tail)
    second = F.trim(F.split_part("line", F.lit(","), F.lit(2)))
    city = F.when(F.col("city").isNotNull(), _fold(F.col("city"))).when(has_comma & (F.length(second) > 2) & ~second.rlike("[0-9]"), second)
    r = r.select(*keep, *([] if "source" in keep else ["source"]), n1.alias("n1"), n2.alias("n2"), F.when(F.col("email").contains("@"), F.col("email")).alias("email"), phone.alias("phone"), dob.alias("dob"), F.when(slash, F.concat_ws("/", part("/", 1), part("/", 2), F.split_part(d, F.lit("/"), F.lit(3)))).alias("slash"), number.alias("number"), street.alias("street"), zip_.alias("zip"), city.alias("city"))
    return r.select(
        *keep, *([] if "source" in keep else ["source"]), "n1", "n2", "email", "phone", "dob", "slash",
        F.when((F.col("number") != "") & (F.col("street") != ""), F.concat_ws(" ", "number", F.substring("street", 1, 6))).alias("addr"),
        F.when(~F.col("zip").isin("", "00000", "99999"), F.col("zip")).alias("zip"), "city",
    )


def whole_name() -> Column:
    """Both name tokens in either order; null unless both are there."""
    return F.when(F.col("n1").isNotNull() & F.col("n2").isNotNull(), F.concat_ws(" ", F.least("n1", "n2"), F.greatest("n1", "n2")))


def identity(*scope: str) -> list[Column]:
    """h1, h2: two hashes (128 bits) equal for records that certainly describe one person:
    equal whole names and birth date; without a whole name or a birth date, only wholly
    equal profiles."""
    sure = (F.length(F.regexp_replace("n1", r"\.", "")) > 1) & (F.length(F.regexp_replace("n2", r"\.", "")) > 1) & F.col("dob").isNotNull()
    cols = [F.col(s) for s in scope]
    of = lambda seed: F.when(sure, F.xxhash64(F.lit(seed), *cols, F.lit(1), "n1", "n2", "dob")).otherwise(F.xxhash64(F.lit(seed), *cols, F.lit(2), *[F.coalesce(F.col(a), F.lit("\x00")) for a in ATTRIBUTES]))
    return [of(11).alias("h1"), of(23).alias("h2")]


def known() -> Column:
    """There is something to match by: a name and another attribute."""
    return F.coalesce("n1", "n2").isNotNull() & F.coalesce("email", "phone", "dob", "addr", "zip", "city").isNotNull()


#: What two profiles may share, as bits of a mask, and its weight (natural log odds, rounded).
EMAIL, PHONE, ADDR, DOB, NEAR_DOB, ZIP, CITY, NAMES = 1, 2, 4, 8, 16, 32, 64, 128
WEIGHTS = {EMAIL: 8.0, PHONE: 8.0, ADDR: 4.0, ZIP: 2.5, CITY: 1.0}
ACCEPT = 9.0


def _token(x: str, y: str, miss: float) -> str:
    a, b = f"replace({x},'.','')", f"replace({y},'.','')"
    return f"""case when {x} is null or {y} is null then 0D when {a} = {b} then 4D
      when length({a}) = 1 or length({b}) = 1 then case when left({a},1) = left({b},1) then 1D else {miss}D end
      when startswith({a},{b}) or startswith({b},{a}) then 2.5D
      when least(length({a}),length({b})) between 3 and 5 and left({a},1) = left({b},1) and abs(length({a}) - length({b})) >= 2
        and levenshtein(left({a},least(length({a}),length({b}))),left({b},least(length({a}),length({b}))),1) = 1 then 2D
      when contains({a},'-') and array_contains(split({a},'-'),{b}) or contains({b},'-') and array_contains(split({b},'-'),{a}) then 3D
      when least(length({a}),length({b})) >= 4 and levenshtein({a},{b},2) between 0 and if(least(length({a}),length({b})) >= 6, 2, 1) then 3D
      when length({a}) = length({b}) and length({a}) >= 4 and array_sort(split({a},'')) = array_sort(split({b},'')) and levenshtein({a},{b},2) between 0 and 2 then 3D
      else {miss}D end"""


#: Birth dates one slip apart: day and month swapped, one digit, a year off, or up to a month of days.
_SLIP = (
    "(substr(a_dob,1,4) = substr(b_dob,1,4) and substr(a_dob,5,2) = substr(b_dob,7,2) and substr(a_dob,7,2) = substr(b_dob,5,2)"
    " or levenshtein(a_dob,b_dob,1) = 1 or abs(try_cast(a_dob as int) - try_cast(b_dob as int)) = 10000"
    " or abs(datediff(try_to_timestamp(a_dob,'yyyyMMdd'), try_to_timestamp(b_dob,'yyyyMMdd'))) <= 31)"
)


_NAMES = f"greatest({_token('a_n1', 'b_n1', -9)} + {_token('a_n2', 'b_n2', -2)}, case when a_n1 = b_n2 or a_n2 = b_n1 then {_token('a_n1', 'b_n2', -9)} + {_token('a_n2', 'b_n1', -9)} - 0.5D else -30D end)"
_DATES = f"case when a_dob is null or b_dob is null then 0D when a_dob = b_dob then 7D when coalesce({_SLIP}, false) then 3D else -9D end"


def scored_edges(pairs: DataFrame) -> DataFrame:
    """a, b, mask, base, clash, a_open, b_open of pairs with columns mask, crowd, a_n1,
    a_n2, a_dob, b_n1, b_n2, b_dob. ``crowd`` is the log of half the number of nodes
    that hold the rarest thing shared: half of it is taken off the base, as a mailbox
    of a hundred people says less than one of two.

    base: agreement of names and birth dates; people of different first names are
    different (relatives and twins share all else). clash: what keeps two profiles
    apart whatever their neighbours share - birth dates more than a slip apart, or
    different first names under one last name and birth date."""
    e = pairs.select("*", F.expr(_NAMES).alias("names"), F.expr(_DATES).alias("dates"))
    other = F.col("names") <= -5
    clash = ~other & (F.col("dates") < 0) | other & (F.col("dates") == 7) & F.expr("coalesce(a_n2 = b_n2, false)")
    return e.select("a", "b", "mask", (F.col("names") + F.col("dates") - F.when(other, 30.0).otherwise(0.0) - F.col("crowd") / 2).alias("base"), clash.alias("clash"), F.col("a_dob").isNull().alias("a_open"), F.col("b_dob").isNull().alias("b_open"))


def shared_score(mask: Column) -> Column:
    out = F.lit(0.0)
    for bit, w in WEIGHTS.items():
        out = out + F.when(mask.bitwiseAND(bit) > 0, w).otherwise(0.0)
    return out


def with_profiles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n1", "n2", "dob")]) for x in "ab")
    return pairs.join(a, "a").join(b, "b")
