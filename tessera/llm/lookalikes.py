"""One common form for texts that look the same.

Method: compatibility normalisation in composed form, full case folding, white space
mapped to a plain space, removal of default-ignorable characters, look-alike letters
mapped to one letter - per distinct character of the corpus, so a text is one table
look-up per character and one composition. Texts without other than ASCII characters
never leave the JVM, whose built-in functions give them the same form.

Only texts whose common form another, different text has are candidates; for them
alone the *visible* form is made, which keeps whatever a reader can see (case,
accents, the shape of digits and pictures), and decides which of them look the same.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.blocking import meetings
from tessera.session import cut

#: Letters of other scripts that are drawn like a Latin letter (fixed values).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "‐": "-", "‑": "-",
}
#: Compatibility mappings that keep the look of a character (others, such as superscripts and circled digits, change it).
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
_LIGATURE = regex.compile(r"[ﬀ-ﬆĲĳǄ-ǌǱ-ǳ]")
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_SPACE = regex.compile(r"[\p{Zs}\t]")
_BREAK = regex.compile(r"\r\n?|[  \x0b\x0c\x85]")
_EDGE = regex.compile(r"[ ]+(?=\n|\Z)")
_VISIBLE = regex.compile(r"[^\p{Z}\p{C}\s\p{Default_Ignorable_Code_Point}]")
# within pictures a joiner, a presentation selector or a tag changes what is drawn
_PICTURE = regex.compile(r"\p{Extended_Pictographic}[\U0001F3FB-\U0001F3FF]?(?:️|︎)?⃣?(?:‍\p{Extended_Pictographic}[\U0001F3FB-\U0001F3FF]?(?:️|︎)?)*[\U000E0020-\U000E007F]*|[0-9#*]️?⃣")
_EMOJI_DEFAULT = regex.compile(r"(\p{Emoji_Presentation})️")


def _one(ch: str) -> str:
    """The visible form of a single character."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    d = unicodedata.decomposition(ch)
    if d.startswith(SAME_LOOK) or _LIGATURE.match(ch):
        return "".join(_one(c) for c in unicodedata.normalize("NFKC", ch))
    if _SPACE.match(ch):
        return " "
    return ch


class _Map(dict):
    def __missing__(self, code: int):
        self[code] = v = _one(chr(code))
        return v


_VISIBLE_MAP = _Map()
_LETTERS = str.maketrans(LOOKALIKES)
_MAYBE_PICTURE = regex.compile("[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff]")


def visible_form(text: str) -> str:
    """What a reader sees: equal for texts that look the same, different otherwise."""
    t = _BREAK.sub("\n", text)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        kept: list[str] = []

        def hold(m):
            kept.append(_EMOJI_DEFAULT.sub(r"\1", m.group()))
            return "\x00"

        t = t.replace("\x00", "")
        if _MAYBE_PICTURE.search(t):
            t = _PICTURE.sub(hold, t)
        t = _IGNORABLE.sub("", t)
        # removal may bring a letter and its accent together
        t = unicodedata.normalize("NFC", t)
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t.translate(_VISIBLE_MAP)).translate(_LETTERS))
        if kept:
            it = iter(kept)
            t = regex.sub("\x00", lambda _: next(it), t)
    else:
        t = t.replace("\t", " ")
    return _EDGE.sub("", t).strip(" \n")


def _common_char(ch: str) -> str:
    """The folded form of one character: nothing if ignorable, a plain space, or its
    compatibility decomposition in folded case with look-alike letters mapped."""
    if _IGNORABLE.match(ch):
        return ""
    if _SPACE.match(ch):
        return " "
    t = unicodedata.normalize("NFKD", ch).translate(_LETTERS).casefold()
    t = unicodedata.normalize("NFKD", t).translate(_LETTERS)
    return _SPACE.sub(" ", _IGNORABLE.sub("", t))


class _Common(dict):
    def __missing__(self, code: int):
        self[code] = v = _common_char(chr(code))
        return v


_COMMON = _Common()


def common_form(text: str) -> str:
    """The form for comparisons: NFKC, full case folding, plain spaces, nothing ignorable, one letter for look-alikes."""
    t = _BREAK.sub("\n", text)
    t = t.replace("\t", " ").lower() if t.isascii() else unicodedata.normalize("NFC", t.translate(_COMMON))
    return _EDGE.sub("", t).strip(" \n")


def ascii_common(c):
    """:func:`common_form` of an ASCII text as a column, without Python."""
    t = F.regexp_replace(F.lower(c), "\r\n?|[\x0b\x0c]", "\n")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("\t"), F.lit(" ")), r" +(?=\n|\z)", ""), F.lit(" \n"))


def has_visible(text: str) -> bool:
    return bool(_VISIBLE.search(text))


def _digest(s: str) -> bytes:
    return hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()


def _keys_by(form):
    """Ids and the digest of the form of their texts, each distinct text of a batch once."""

    def run(batches):
        for b in batches:
            texts = b.column(1).dictionary_encode()
            keys = pa.array([_digest(form(t)) if t is not None and has_visible(t) else None for t in texts.dictionary.to_pylist()], pa.binary()).take(texts.indices)
            yield pa.RecordBatch.from_arrays([b.column(0), keys], ["doc_id", "key"])

    return run


def look_keys(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, common_key: 128-bit digests of every text with a visible
    character and of its common form. Texts never leave their task."""
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    plain = F.length("t") == F.octet_length("t")
    text_key = F.unhex(F.md5("t")).alias("text_key")
    easy = d.where(plain & F.col("t").rlike("[\x21-\x7e]")).select("doc_id", text_key, F.unhex(F.md5(ascii_common(F.col("t")))).alias("common_key"))
    hard = d.where(~plain).select("doc_id", "t", text_key).mapInArrow(_common_keys, "doc_id long, text_key binary, common_key binary").where("common_key is not null")
    return easy.unionByName(hard)


def _common_keys(batches):
    for b in batches:
        for k in _keys_by(common_form)([b]):
            yield pa.RecordBatch.from_arrays([k.column(0), b.column(2), k.column(1)], ["doc_id", "text_key", "common_key"])


def same_look(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, class_key, links of every document whose text looks like a
    different text of another document; links is the number of such documents.
    Classes whose texts are all one string drop out; repeated rows count once."""
    k = cut(look_keys(docs, id, text).dropDuplicates(["doc_id"]))
    many = k.groupBy("common_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("common_key")
    cand = cut(k.join(many, "common_key", "left_semi"))
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t")).join(cand.select("doc_id"), "doc_id", "left_semi")
    seen = d.mapInArrow(_keys_by(visible_form), "doc_id long, key binary").dropDuplicates(["doc_id"])
    v = cut(cand.join(seen, "doc_id").select("doc_id", "text_key", F.sha2(F.concat("common_key", "key"), 256).alias("class_key")), k)
    texts = v.groupBy("class_key", "text_key").agg(F.count("*").alias("copies"))
    size = texts.groupBy("class_key").agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("m > 1").select("class_key", "n")
    links = texts.join(size, "class_key").select("class_key", "text_key", (F.col("n") - F.col("copies")).alias("links"))
    return v.join(links, ["class_key", "text_key"]).select("doc_id", "text_key", "class_key", "links")


def look_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int = 8) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents whose texts look the same and are
    different strings. Different strings of a class meet first, then each takes its
    documents, in ``parts`` parts a side: pairs of equal strings are never made, and
    copies of one text are no hot key."""
    s = cut(same_look(docs, id, text).select("doc_id", "text_key", "class_key"))
    strings = s.select("class_key", "text_key").distinct()
    met = meetings(strings, ["class_key"], "text_key").select(F.col("x.text_key").alias("kx"), F.col("y.text_key").alias("ky"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = met.withColumn("i", every).withColumn("j", every)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    x, y = s.select(F.col("doc_id").alias("x"), F.col("text_key").alias("kx"), part.alias("i")), s.select(F.col("doc_id").alias("y"), F.col("text_key").alias("ky"), part.alias("j"))
    p = met.join(x, ["kx", "i"]).join(y, ["ky", "j"])
    return p.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


@F.pandas_udf(StringType())
def common_form_of(s: pd.Series) -> pd.Series:
    u = {t: common_form(t) for t in s.dropna().unique()}
    return pd.Series([u.get(t) for t in s], dtype=object)
