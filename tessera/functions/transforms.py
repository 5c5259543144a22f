"""Column transforms by name.

Every transform is a builder ``(Column, *args) -> Column`` of built-in
expressions, so chains of them collapse into one projection and run inside
whole-stage codegen. ``apply(col, "pad_left:12:0")`` parses the textual form;
``chain`` applies several in order. Null in, null out unless stated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., Column]] = {}
CATEGORY: dict[str, str] = {}


def register(category: str):
    def add(f):
        REGISTRY[f.__name__.rstrip("_")] = f
        CATEGORY[f.__name__.rstrip("_")] = category
        return f

    return add


def parse(raw: str) -> tuple[str, list[str]]:
    """``name:arg1:arg2`` -> (name, [arg1, arg2])."""
    name, *args = raw.split(":")
    return name, args


def apply(col: Column | str, raw: str) -> Column:
    name, args = parse(raw)
    if name not in REGISTRY:
        raise NotImplementedError(f"unknown transform {name!r}")
    return REGISTRY[name](F.col(col) if isinstance(col, str) else col, *args)


def chain(col: Column | str, names: list[str]) -> Column:
    return reduce(apply, names, F.col(col) if isinstance(col, str) else col)


def _rep(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def _map(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[c], c if default is None else default)


def _digits(c: Column) -> Column:
    return _rep(c, "[^0-9]")


def _number(c: Column) -> Column:
    return c.try_cast("double")


_FOLD = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()}


def fold_accents(c: Column) -> Column:
    return F.translate(c, "".join(_FOLD), "".join(_FOLD.values()))


# ---- text ---------------------------------------------------------------
@register("text")
def lowercase(c):
    return F.lower(c)


@register("text")
def uppercase(c):
    return F.upper(c)


@register("text")
def strip(c):
    return _rep(c, r"^\s+|\s+$")


@register("text")
def collapse_whitespace(c):
    """Runs of white space become one space; the ends are not trimmed."""
    return _rep(c, r"\s+", " ")


@register("text")
def extract_numbers(c):
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), 1), " ")


@register("text")
def fix_mojibake(c):
    """Text whose UTF-8 bytes were read as Latin-1 is read again; other text stays."""
    again = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return F.when(c.rlike("[ÂÃâ]") & ~c.rlike("[^\\x00-\\xff]"), F.coalesce(again, c)).otherwise(c)


@register("text")
def normalize_line_endings(c):
    return _rep(c, r"\r\n?", "\n")


@register("text")
def normalize_quotes(c):
    return F.translate(c, "‘’‚‛“”„‟′″«»", "''''\"\"\"\"'\"\"\"")


@register("text")
def normalize_unicode(c):
    return fold_accents(c)


@register("text")
def pad_left(c, width="10", fill="0"):
    """Longer text is not cut."""
    return F.when(F.length(c) >= int(width), c).otherwise(F.lpad(c, int(width), fill))


@register("text")
def pad_right(c, width="10", fill=" "):
    return F.when(F.length(c) >= int(width), c).otherwise(F.rpad(c, int(width), fill))


@register("text")
def remove_digits(c):
    return _rep(c, "[0-9]")


@register("text")
def remove_emojis(c):
    return _rep(c, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\x{2B50}\x{2B55}]")


@register("text")
def remove_html_tags(c):
    return _rep(c, r"<[^>]*>")


@register("text")
def remove_punctuation(c):
    return _rep(c, r"[^A-Za-z0-9\s]")


@register("text")
def remove_urls(c):
    return _rep(c, r"https?://\S+")


@register("text")
def title_case(c):
    return F.initcap(F.lower(c))


@register("text")
def truncate(c, n="255"):
    return F.substring(c, 1, max(0, int(n)))


# ---- names --------------------------------------------------------------
#: Titles and suffixes that are dropped from names (fixed values).
TITLES = "mr|mrs|ms|miss|mx|dr|prof|sir|madam|rev|hon"
SUFFIXES = "jr|sr|ii|iii|iv|v|phd|md|esq|cpa|dds"
NICKNAMES = {
    "bob": "Robert", "rob": "Robert", "bobby": "Robert", "bill": "William", "will": "William", "billy": "William", "jim": "James", "jimmy": "James", "mike": "Michael",
    "tom": "Thomas", "dick": "Richard", "rick": "Richard", "liz": "Elizabeth", "beth": "Elizabeth", "betty": "Elizabeth", "kate": "Katherine", "kathy": "Katherine",
    "peggy": "Margaret", "maggie": "Margaret", "tony": "Anthony", "dave": "David", "dan": "Daniel", "steve": "Steven", "chris": "Christopher", "joe": "Joseph",
    "sam": "Samuel", "ben": "Benjamin", "jack": "John", "sue": "Susan", "jen": "Jennifer", "alex": "Alexander", "andy": "Andrew", "greg": "Gregory", "matt": "Matthew",
}


@register("name")
def initial_expand(c):
    """True for names that hold a bare initial and need review."""
    return c.rlike(r"(?:^|\s)[A-Za-z]\.?(?:\s|$)")


@register("name")
def merge_name(c, other="last_name"):
    return _blank_null(F.concat_ws(" ", F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(F.col(other)), F.lit(""))))


@register("name")
def name_initials(c):
    return F.upper(F.array_join(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), ""))


@register("name")
def name_proper(c):
    """Proper case that knows O'Brien, Mary-Ann and McDonald."""
    t = F.initcap(_rep(_rep(F.lower(F.trim(c)), r"(['-])", "$1 "), r"\s+", " "))
    t = _rep(t, r"(['-]) ", "$1")
    mc = F.transform(F.split(t, " "), lambda w: F.when(w.rlike("^Mc[a-z]"), F.concat(F.lit("Mc"), F.initcap(w.substr(F.lit(3), F.length(w))))).otherwise(w))
    return F.array_join(mc, " ")


@register("name")
def name_script(c):
    n = lambda p: F.length(c) - F.length(_rep(c, p))
    scripts = [("Latin", r"\p{IsLatin}"), ("Cyrillic", r"\p{IsCyrillic}"), ("Greek", r"\p{IsGreek}"), ("Han", r"\p{IsHan}"), ("Hiragana", r"\p{IsHiragana}"), ("Katakana", r"\p{IsKatakana}"), ("Arabic", r"\p{IsArabic}"), ("Hebrew", r"\p{IsHebrew}"), ("Hangul", r"\p{IsHangul}")]
    best = F.array_max(F.array(*[F.struct(n(p).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (s, p) in enumerate(scripts)]))
    return F.when(c.isNotNull(), F.when(best["n"] > 0, best["s"]).otherwise("Unknown"))


@register("name")
def name_transliterate(c):
    t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), {"Æ": "AE", "æ": "ae", "ß": "ss", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l"}.items(), c)
    return _rep(fold_accents(t), r"[^\x00-\x7f]")


@register("name")
def nickname_standardize(c):
    return _map(F.lower(F.trim(c)), NICKNAMES, c)


@register("name")
def split_name(c):
    t = F.split(F.trim(_rep(c, r"\s+", " ")), " ")
    return F.struct(F.element_at(t, 1).alias("first_name"), F.when(F.size(t) > 1, F.element_at(t, -1)).otherwise("").alias("last_name"))


@register("name")
def split_name_reverse(c):
    return F.struct(F.trim(F.substring_index(c, ",", -1)).alias("first_name"), F.trim(F.substring_index(c, ",", 1)).alias("last_name"))


@register("name")
def strip_middle(c):
    t = F.split(F.trim(_rep(c, r"\s+", " ")), " ")
    return F.when(F.size(t) > 2, F.concat_ws(" ", F.element_at(t, 1), F.element_at(t, -1))).otherwise(c)


@register("name")
def strip_suffixes(c):
    return F.trim(_rep(c, rf"(?i)(?:,?\s+(?:{SUFFIXES})\.?)+\s*$"))


@register("name")
def strip_titles(c):
    return F.trim(_rep(c, rf"(?i)^\s*(?:(?:{TITLES})\.?\s+)+"))


# ---- email, url ---------------------------------------------------------
_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@register("email")
def email_lowercase(c):
    return F.lower(F.trim(c))


@register("email")
def email_normalize(c):
    """Tag dropped, dots of gmail addresses dropped; what is no address stays as it is."""
    e = F.lower(F.trim(c))
    local, domain = _rep(F.substring_index(e, "@", 1), r"\+.*$"), F.substring_index(e, "@", -1)
    local = F.when(domain.isin("gmail.com", "googlemail.com"), F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    return F.when(e.rlike(_EMAIL), F.concat_ws("@", local, domain)).otherwise(c)


@register("email")
def email_canonical(c):
    return _rep(email_normalize(c), "@googlemail\\.com$", "@gmail.com")


@register("email")
def email_extract_domain(c):
    return F.when(c.contains("@"), F.lower(F.trim(F.substring_index(c, "@", -1))))


@register("email")
def email_mask(c):
    return F.when(c.rlike(_EMAIL), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1)))


@register("email")
def email_validate(c):
    return F.trim(c).rlike(_EMAIL)


@register("url")
def url_normalize(c):
    u = F.trim(c)
    u = F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    head, rest = F.lower(F.regexp_extract(u, r"^([^/]+//[^/?#]*)", 1)), F.regexp_extract(u, r"^[^/]+//[^/?#]*(.*)$", 1)
    rest = F.when(rest == "/", "").otherwise(rest)
    return F.when(F.trim(c) != "", F.concat(head, rest))


@register("url")
def url_extract_domain(c):
    return _blank_null(F.lower(F.regexp_extract(F.trim(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^@/?#]*@)?([^:/?#]+)", 1)))


@register("url")
def url_strip_www(c):
    return _rep(c, r"(?i)^([a-z][a-z0-9+.-]*://)?www\.", "$1")


@register("url")
def url_strip_tracking(c):
    t = _rep(c, r"(?i)(?<=[?&])(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_[ce]id|igshid|ref)=[^&#]*&?")
    return _rep(t, r"[?&]+(?=#|$)")


@register("url")
def url_canonical(c):
    return _rep(url_strip_www(url_strip_tracking(url_normalize(c))), r"/$")


# ---- phone --------------------------------------------------------------
def _phone(c):
    d = _digits(c)
    plus = F.trim(c).startswith("+")
    national = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    return d, plus, national


@register("phone")
def phone_digits(c):
    return _digits(c)


@register("phone")
def phone_e164(c):
    d, plus, national = _phone(c)
    return F.when(national.isNotNull() & (~plus | d.startswith("1")), F.concat(F.lit("+1"), national)).when(plus & F.length(d).between(8, 15), F.concat(F.lit("+"), d)).otherwise(c)


@register("phone")
def phone_national(c):
    _, _, n = _phone(c)
    return F.when(n.isNotNull(), F.concat(F.lit("("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 4))).otherwise(c)


@register("phone")
def phone_country_code(c):
    d, plus, n = _phone(c)
    two = F.substring(d, 1, 2).isin("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
    return F.when(plus & d.startswith("1"), F.lit(1)).when(plus & d.startswith("7"), F.lit(7)).when(plus & two, F.substring(d, 1, 2).try_cast("int")).when(plus & (F.length(d) > 8), F.substring(d, 1, 3).try_cast("int")).when(n.isNotNull(), F.lit(1))


@register("phone")
def phone_validate(c):
    d, plus, n = _phone(c)
    return n.isNotNull() | (plus & F.length(d).between(8, 15))


# ---- dates --------------------------------------------------------------
_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MM-dd-yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]


def _date(c, *formats):
    s = F.trim(c.cast("string"))
    year = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (formats or _FORMATS)], F.try_to_timestamp(year, F.lit("yyyy-MM-dd")), *([] if formats else [s.try_cast("timestamp")]))


@register("date")
def date_iso8601(c):
    """Unparseable text stays as it is."""
    return F.coalesce(F.date_format(_date(c), "yyyy-MM-dd"), c.cast("string"))


@register("date")
def date_parse(c):
    return F.date_format(_date(c), "yyyy-MM-dd")


@register("date")
def date_us(c):
    return F.coalesce(F.date_format(_date(c), "MM/dd/yyyy"), c.cast("string"))


@register("date")
def date_eu(c):
    return F.coalesce(F.date_format(_date(c), "dd/MM/yyyy"), c.cast("string"))


@register("date")
def date_shift(c, days="0"):
    return F.date_format(F.date_add(_date(c).cast("date"), int(days)), "yyyy-MM-dd")


@register("date")
def date_validate(c):
    return F.when(c.isNotNull(), _date(c).isNotNull())


@register("date")
def datetime_iso8601(c):
    return F.coalesce(F.date_format(_date(c), "yyyy-MM-dd'T'HH:mm:ss"), c.cast("string"))


@register("date")
def age_from_dob(c, today=None):
    now = F.current_date() if today is None else F.lit(today).cast("date")
    return F.floor(F.months_between(now, _date(c).cast("date")) / 12).cast("int")


@register("date")
def extract_year(c):
    return F.year(_date(c))


@register("date")
def extract_month(c):
    return F.month(_date(c))


@register("date")
def extract_day(c):
    return F.dayofmonth(_date(c))


@register("date")
def extract_quarter(c):
    return F.quarter(_date(c))


@register("date")
def extract_day_of_week(c):
    return F.date_format(_date(c), "EEEE")


# ---- numbers ------------------------------------------------------------
_ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]


@register("numeric")
def abs_value(c):
    return F.abs(c)


@register("numeric")
def clamp(c, low="0", high="1"):
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


@register("numeric")
def comma_decimal(c):
    return _number(F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c))


@register("numeric")
def currency_strip(c):
    return _number(_rep(c, r"[^0-9.\-]"))


@register("numeric")
def fill_zero(c):
    return F.coalesce(c, F.lit(0.0))


@register("numeric")
def fraction_to_decimal(c):
    g = lambda i: _number(F.regexp_extract(F.trim(c), r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)$", i))
    return F.when(F.trim(c).rlike(r"^(?:\d+\s+)?\d+\s*/\s*\d+$"), F.coalesce(g(1), F.lit(0.0)) + F.try_divide(g(2), g(3))).otherwise(_number(c))


@register("numeric")
def ordinal_to_int(c):
    words = F.create_map(*[x for i, w in enumerate(_ORDINALS) for x in (F.lit(w), F.lit(i + 1))])
    return F.coalesce(words[F.lower(F.trim(c))], F.regexp_extract(F.lower(F.trim(c)), r"^(\d+)(?:st|nd|rd|th)?$", 1).try_cast("int"))


@register("numeric")
def percentage_normalize(c):
    n = _number(_rep(c, r"[%\s]"))
    return F.when(c.contains("%"), n / 100).otherwise(n)


@register("numeric")
def roman_to_int(c):
    """1 to 3999; only well-formed numerals."""
    r = F.upper(F.trim(c))
    v = F.create_map(*[x for k, n in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in (F.lit(k), F.lit(n))])
    vals = F.transform(F.split(r, ""), lambda x: v[x])
    total = F.aggregate(F.zip_with(vals, F.concat(F.slice(vals, 2, 99), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda a, b: a + b)
    return F.when(r.rlike(r"^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


@register("numeric")
def round_(c, digits="0"):
    """Half away from zero by multiply, round, divide."""
    k = 10.0 ** int(digits)
    return F.signum(c) * F.floor(F.abs(c) * k + 0.5) / k


@register("numeric")
def scientific_to_decimal(c):
    return _number(F.trim(c))


@register("numeric")
def to_integer(c):
    return _number(c.cast("string")).try_cast("bigint")


# ---- categories ---------------------------------------------------------
NULL_WORDS = ["n/a", "null", "none", "na", "nil", "nan", "-", ""]


@register("categorical")
def boolean_normalize(c):
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "t", "yes", "y", "1", "on"), True).when(v.isin("false", "f", "no", "n", "0", "off"), False)


@register("categorical")
def gender_standardize(c):
    v = F.lower(F.trim(c))
    return F.when(v.isin("male", "m", "man"), "M").when(v.isin("female", "f", "woman"), "F").otherwise(c)


@register("categorical")
def null_standardize(c):
    return F.when(~F.lower(F.trim(c)).isin(NULL_WORDS), c)


@register("categorical")
def category_standardize(c, mapping=None):
    table = {v.lower(): k for k, vs in (mapping or {}).items() for v in [k, *vs]}
    return _map(F.lower(F.trim(c)), table, c) if table else c


@register("categorical")
def category_from_file(c, path=None):
    """Mapping file: one ``variant,canonical`` pair a line (read on the driver)."""
    import csv

    with open(path, newline="") as f:
        table = {r[0].strip().lower(): r[1].strip() for r in csv.reader(f) if len(r) > 1}
    return _map(F.lower(F.trim(c)), table, c) if table else c


# ---- companies ----------------------------------------------------------
LEGAL = "incorporated|inc|corporation|corp|company|co|limited|ltd|llc|llp|lp|plc|gmbh|ag|sa|sarl|bv|nv|oy|ab|as|pty|kg|spa|srl"


@register("company")
def company_extract_legal(c):
    return _blank_null(F.lower(F.regexp_extract(F.trim(c), rf"(?i)[\s,]+({LEGAL})\.?$", 1)))


@register("company")
def company_strip_legal(c):
    return F.trim(_rep(F.trim(c), rf"(?i)(?:[\s,]+(?:{LEGAL})\.?)+$"))


@register("company")
def company_normalize(c):
    return F.trim(_rep(_rep(_rep(F.lower(company_strip_legal(c)), r"[^\w\s&]", " "), r"\s+", " "), r"^the "))


# ---- addresses ----------------------------------------------------------
STREETS = {"street": "St", "avenue": "Ave", "boulevard": "Blvd", "road": "Rd", "lane": "Ln", "drive": "Dr", "court": "Ct", "place": "Pl", "square": "Sq", "highway": "Hwy", "parkway": "Pkwy", "terrace": "Ter", "circle": "Cir", "trail": "Trl"}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
COUNTRIES = {"united states": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "america": "US", "united kingdom": "GB", "uk": "GB", "england": "GB", "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "italy": "IT", "canada": "CA", "mexico": "MX", "japan": "JP", "china": "CN", "india": "IN", "brazil": "BR", "australia": "AU", "netherlands": "NL", "switzerland": "CH", "austria": "AT", "sweden": "SE", "norway": "NO", "denmark": "DK", "poland": "PL", "russia": "RU"}


def _words(c, f):
    return F.array_join(F.transform(F.split(F.trim(_rep(c, r"\s+", " ")), " "), f), " ")


@register("address")
def address_standardize(c):
    m = F.create_map(*[F.lit(x) for kv in STREETS.items() for x in kv])
    return _words(c, lambda w: F.coalesce(m[_rep(F.lower(w), r"[.,]$")], F.initcap(F.lower(w))))


@register("address")
def address_expand(c):
    m = F.create_map(*[F.lit(x) for k, v in STREETS.items() for x in (v.lower(), k.title())])
    return _words(c, lambda w: F.coalesce(m[_rep(F.lower(w), r"[.,]$")], w))


@register("address")
def country_standardize(c):
    return _map(F.lower(F.trim(c)), COUNTRIES, c)


@register("address")
def split_address(c):
    p = r"^\s*([^,]+),\s*([^,]+),\s*([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
    return F.struct(*[_blank_null(F.regexp_extract(c, p, i + 1)).alias(n) for i, n in enumerate(["street", "city", "state", "zip"])])


@register("address")
def state_abbreviate(c):
    return _map(F.lower(F.trim(c)), STATES, c)


@register("address")
def state_expand(c):
    return _map(F.upper(F.trim(c)), {v: k.title() for k, v in STATES.items()}, c)


@register("address")
def unit_normalize(c):
    return _rep(c, r"(?i)(?:\b(?:apartment|apt|unit|suite|ste)\b\.?\s*#?\s*|#\s*)(\w+)", "Unit $1")


@register("address")
def zip_normalize(c):
    d = F.regexp_extract(F.trim(c), r"^(\d{3,5})(?:-?\d{4})?$", 1)
    return F.when(d != "", F.lpad(d, 5, "0")).otherwise(c)


# ---- identifiers --------------------------------------------------------
def _digit_array(d):
    return F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x: x.cast("int"))


def _luhn(d):
    a = F.reverse(_digit_array(d))
    s = F.aggregate(F.transform(a, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda p, q: p + q)
    return (F.length(d) > 0) & (s % 10 == 0)


def _weighted(d, weights):
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(_digit_array(d), w, lambda x, y: x * y), F.lit(0), lambda p, q: p + q)


def _clean_id(c):
    return F.upper(_rep(c, r"[\s-]"))


def _only(ok_shape, check):
    return F.when(ok_shape, check).otherwise(F.lit(False))


@register("identifier")
def aba_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^\d{9}$"), _weighted(_digits(d), [3, 7, 1] * 3) % 10 == 0)


@register("identifier")
def cc_brand(c):
    d = _clean_id(c)
    return F.when(d.rlike(r"^4(\d{12}|\d{15}|\d{18})$"), "visa").when(d.rlike(r"^(5[1-5]\d{14}|2(2[2-9]|[3-6]\d|7[01])\d{13}|2720\d{12})$"), "mastercard").when(d.rlike(r"^3[47]\d{13}$"), "amex").when(d.rlike(r"^(6011|65\d\d|64[4-9]\d)\d{12}$"), "discover").when(d.rlike(r"^3(0[0-5]|[68]\d)\d{11}$"), "diners").when(d.rlike(r"^35(2[89]|[3-8]\d)\d{12}$"), "jcb")


@register("identifier")
def cc_format(c):
    d = _digits(c)
    return F.when(F.length(d) == 15, _rep(d, r"^(\d{4})(\d{6})(\d{5})$", "$1 $2 $3")).when(F.length(d) == 16, _rep(d, r"(\d{4})(?=\d)", "$1 ")).otherwise(c)


@register("identifier")
def cc_mask(c):
    d = _digits(c)
    return F.when(F.length(d) >= 4, F.concat(F.repeat(F.lit("*"), F.length(d) - 4), F.right(d, F.lit(4))))


@register("identifier")
def cc_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^\d{13,19}$"), _luhn(_digits(d)))


def _alnum_value(x):
    return F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)


def _chars(d):
    return F.filter(F.split(d, ""), lambda x: x != "")


@register("identifier")
def cusip_validate(c):
    d = _clean_id(c)
    v = F.transform(_chars(F.substring(d, 1, 8)), lambda x, i: F.when(i % 2 == 1, _alnum_value(x) * 2).otherwise(_alnum_value(x)))
    s = F.aggregate(F.transform(v, lambda x: F.floor(x / 10) + x % 10), F.lit(0).cast("long"), lambda a, b: a + b)
    return _only(d.rlike(r"^[0-9A-Z]{8}\d$"), (10 - s % 10) % 10 == F.substring(d, 9, 1).try_cast("int"))


@register("identifier")
def ean_validate(c):
    d = F.lpad(_clean_id(c), 14, "0")
    return _only(_clean_id(c).rlike(r"^(\d{8}|\d{12,14})$"), _weighted(_digits(d), [3, 1] * 7) % 10 == 0)


@register("identifier")
def ein_format(c):
    d = _digits(c)
    return F.when(F.length(d) == 9, _rep(d, r"^(\d\d)(\d{7})$", "$1-$2")).otherwise(c)


@register("identifier")
def iban_format(c):
    return F.trim(_rep(_clean_id(c), r"(.{4})", "$1 "))


@register("identifier")
def iban_validate(c):
    d = _clean_id(c)
    moved = F.concat(d.substr(F.lit(5), F.length(d)), F.substring(d, 1, 4))
    rem = F.aggregate(_chars(moved), F.lit(0), lambda a, x: (a * F.when(x.rlike("[0-9]"), 10).otherwise(100) + _alnum_value(x)) % 97)
    return _only(d.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), rem == 1)


@register("identifier")
def imei_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^\d{15}$"), _luhn(_digits(d)))


@register("identifier")
def isbn_normalize(c):
    d = _clean_id(c)
    core = F.concat(F.lit("978"), F.substring(d, 1, 9))
    check = (10 - _weighted(_digits(core), [1, 3] * 6) % 10) % 10
    return F.when(d.rlike(r"^\d{9}[\dX]$"), F.concat(core, check.cast("string"))).when(d.rlike(r"^\d{13}$"), d).otherwise(c)


@register("identifier")
def isbn_validate(c):
    d = _clean_id(c)
    last = F.when(F.substring(d, 10, 1) == "X", 10).otherwise(F.substring(d, 10, 1).try_cast("int"))
    ten = (_weighted(_digits(F.substring(d, 1, 9)), list(range(10, 1, -1))) + last) % 11 == 0
    return F.when(d.rlike(r"^\d{9}[\dX]$"), ten).when(d.rlike(r"^97[89]\d{10}$"), _weighted(_digits(d), [1, 3] * 6 + [1]) % 10 == 0).otherwise(F.lit(False))


@register("identifier")
def isin_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^[A-Z]{2}[A-Z0-9]{9}\d$"), _luhn(F.array_join(F.transform(_chars(d), lambda x: _alnum_value(x).cast("string")), "")))


@register("identifier")
def luhn_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^\d+$"), _luhn(_digits(d)))


@register("identifier")
def npi_validate(c):
    d = _clean_id(c)
    return _only(d.rlike(r"^\d{10}$"), _luhn(F.concat(F.lit("80840"), _digits(d))))


@register("identifier")
def ssn_format(c):
    d = _digits(c)
    return F.when(F.length(d) == 9, _rep(d, r"^(\d{3})(\d\d)(\d{4})$", "$1-$2-$3")).otherwise(c)


@register("identifier")
def ssn_mask(c):
    d = _digits(c)
    return F.when(F.length(d) == 9, F.concat(F.lit("***-**-"), F.right(d, F.lit(4))))


@register("identifier")
def ssn_validate(c):
    return _clean_id(c).rlike(r"^(?!000|666|9\d\d)\d{3}(?!00)\d{2}(?!0000)\d{4}$")


_BIC = r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"


@register("identifier")
def swift_format(c):
    return F.when(_clean_id(c).rlike(_BIC), _clean_id(c))


@register("identifier")
def swift_validate(c):
    return _clean_id(c).rlike(_BIC)


@register("identifier")
def vat_format(c):
    return F.upper(_rep(c, r"[\s.-]"))


@register("identifier")
def vat_validate(c):
    return vat_format(c).rlike(r"^(ATU\d{8}|BE[01]\d{9}|BG\d{9,10}|CY\d{8}[A-Z]|CZ\d{8,10}|DE\d{9}|DK\d{8}|EE\d{9}|(EL|GR)\d{9}|ES[A-Z0-9]\d{7}[A-Z0-9]|FI\d{8}|FR[A-Z0-9]{2}\d{9}|HR\d{11}|HU\d{8}|IE\d[A-Z0-9+*]\d{5}[A-Z]{1,2}|IT\d{11}|LT(\d{9}|\d{12})|LU\d{8}|LV\d{11}|MT\d{8}|NL\d{9}B\d{2}|PL\d{10}|PT\d{9}|RO\d{2,10}|SE\d{12}|SI\d{8}|SK\d{10})$")


# ---- phonetic -----------------------------------------------------------
@register("phonetic")
def soundex(c):
    """Accents folded; text without a letter gives the empty string."""
    letters = _rep(F.upper(name_transliterate(c)), "[^A-Z]")
    return F.when(c.isNotNull(), F.when(letters == "", F.lit("")).otherwise(F.soundex(letters)))


# ---- domain packs -------------------------------------------------------
@register("domain")
def sku_normalize(c):
    return _rep(F.upper(F.trim(c)), r"[\s_./]+", "-")


@register("domain")
def account_mask(c):
    d = _rep(c, r"\s")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(d) - 4, F.lit(0))), F.right(d, F.lit(4)))


@register("domain")
def cusip_format(c):
    return _clean_id(c)


@register("domain")
def icd10_format(c):
    d = F.upper(_rep(c, r"[\s.]"))
    return F.when(F.length(d) > 3, F.concat(F.substring(d, 1, 3), F.lit("."), d.substr(F.lit(4), F.length(d)))).otherwise(d)


@register("domain")
def mls_normalize(c):
    return _rep(F.upper(F.trim(c)), r"^(MLS)?[\s#:]*|[\s-]")


@register("domain")
def latlng_pack(c, other="lng"):
    return F.concat_ws(",", c.cast("string"), F.col(other).cast("string"))


@register("domain")
def derive_initialism(c):
    """Initials of a full name without its legal form and small words."""
    words = F.filter(F.split(company_strip_legal(c), r"[\s-]+"), lambda w: (w != "") & ~F.lower(w).isin("of", "the", "and", "for", "in", "&"))
    return F.when(F.size(words) >= 2, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))
