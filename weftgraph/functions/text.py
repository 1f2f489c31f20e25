"""Text functions on columns: SQL expressions first, Arrow UDFs where SQL falls short."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as k

_ASCII = "^[\\x00-\\x7F]*$"
_MARKS = r"[!-/:-@\[-`{-~]"
THAI = "[\\u0E00-\\u0E7F]"


def _text_udf(f: Callable[[str], object], kind: T.DataType | str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _pair_udf(f: Callable[[str, str], object], kind: T.DataType | str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return run


#: White space as Unicode has it; ``\\s`` alone is that of ASCII.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def pieces(text: Column, pattern: str = SPACE + "+") -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def _ascii_title(text: Column, plural: bool) -> Column:
    def strip(w: Column) -> Column:
        plain = (F.length(w) > 3) & w.rlike("^[a-z]+$") & w.endswith("s") & ~w.endswith("ss") & ~w.rlike("[aeiouy]es$")
        return F.when(plain, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    def split(raw: Column) -> Column:
        parts = pieces(F.regexp_replace(raw, _MARKS, " "), " ")
        if not plural:
            return parts
        owner = raw.rlike("'s?$")
        return F.transform(parts, lambda p, i: F.when(owner & (i == F.size(parts) - 1), p).otherwise(strip(p)))

    tokens = F.flatten(F.transform(pieces(F.lower(text)), split))
    article = (F.size(tokens) > 1) & F.get(tokens, F.lit(0)).isin(*k.ARTICLES)
    return F.array_join(F.when(article, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens), " ")


def _title(text: Column, plural: bool) -> Column:
    slow = _text_udf(lambda s: k.title_key(s, plural), "string")
    ascii_only = text.rlike(_ASCII)
    return F.coalesce(F.when(ascii_only, _ascii_title(text, plural)), slow(F.when(~ascii_only, text)))


def norm_title(text: Column) -> Column:
    """Comparison key of titles, plural endings stripped (N1)."""
    return _title(text, True)


def norm_name(text: Column) -> Column:
    """Comparison key of titles with plural endings kept (N2)."""
    return _title(text, False)


def plain_text(text: Column) -> Column:
    """Words only, for map lookups (N3)."""
    return _text_udf(k.plain_text, "string")(text)


def answer_text(text: Column) -> Column:
    """Form in which answers are compared (N4)."""
    return _text_udf(k.answer_text, "string")(text)


def squeezed(text: Column) -> Column:
    """N4 without spaces (N5)."""
    return _text_udf(k.squeezed, "string")(text)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays as sets; 0 where one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x, y)) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct features found in the text's."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text)).cast("double") / F.size(q))


def title_similarity(a: Column, b: Column) -> Column:
    return _pair_udf(k.title_similarity, "double")(a, b)


def gestalt(a: Column, b: Column) -> Column:
    return _pair_udf(k.gestalt, "double")(a, b)


def latin_features(text: Column) -> Column:
    """Lower-cased Latin words (all features of texts without Thai)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def features(text: Column) -> Column:
    """Latin words, then trigrams of Thai runs."""
    runs = F.regexp_extract_all(text, F.lit(THAI + "+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 2, F.lit(1))), lambda i: F.substring(r, i, F.lit(3)))))
    return F.concat(latin_features(text), grams)


def hashed_vector(text: Column) -> Column:
    return _text_udf(k.hashed_vector, "array<double>")(text)


def estimate_tokens_pieces(text: Column) -> Column:
    """Token estimate A: per piece 1 + ASCII characters / 8, and 1 per other character.

    Without the characters beyond ASCII, each piece that is left counts once, and once
    more for every eight characters: three passes over the text, whatever its words.
    """
    spaced = F.regexp_replace(text, SPACE, " ")
    plain = F.regexp_replace(spaced, "[^\\x00-\\x7F]", "")
    return (F.regexp_count(plain, F.lit(r"[^ ]+")) + F.regexp_count(plain, F.lit("[^ ]{8}")) + F.length(spaced) - F.length(plain)).cast("long")


def estimate_tokens_words(text: Column) -> Column:
    """Token estimate B: Thai characters / 2.5 and words * 1.3, rounded half to even, 1 at least."""
    thai = F.length(F.regexp_replace(text, "[^\\u0E00-\\u0E7F]", ""))
    words = F.regexp_count(F.regexp_replace(F.regexp_replace(text, THAI, " "), SPACE, " "), F.lit("[^ ]+"))
    return F.greatest(F.lit(1), F.bround(thai / F.lit(2.5) + words * F.lit(1.3))).cast("long")


def detect_language(text: Column) -> Column:
    return F.when(text.rlike(THAI), F.lit("th")).otherwise(F.lit("en"))


def count_words(text: Column) -> Column:
    """Words; a Thai run counts a word for five characters, rounded, and one more when mixed."""

    def of(w: Column) -> Column:
        thai = F.length(F.regexp_replace(w, "[^\\u0E00-\\u0E7F]", ""))
        run = F.greatest(F.lit(1), F.bround(thai / F.lit(5.0)).cast("int"))
        return F.when(thai == 0, F.lit(1)).otherwise(run + (thai < F.length(w)).cast("int"))

    return F.aggregate(pieces(text), F.lit(0).cast("long"), lambda a, w: a + of(w).cast("long"))


#: fixed values: Thai question particles
PARTICLES = ("ไหม", "หรือไม่", "อะไร", "ทำไม", "อย่างไร", "เท่าไร")


def count_questions(text: Column) -> Column:
    """Question marks; without any, sentences with a Thai question particle."""
    marks = F.regexp_count(text, F.lit("[?\\uFF1F]"))
    sentences = F.split(F.lower(text), r"[\n.!?]+|\s{2,}")
    asked = F.size(F.filter(sentences, lambda s: s.rlike("|".join(PARTICLES))))
    return F.when(marks > 0, marks).otherwise(asked).cast("long")


def slug(text: Column) -> Column:
    return _text_udf(k.slug, "string")(text)


def url_stem(url: Column) -> Column:
    """host-path-hash, the file stem of an address."""
    host = F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)), "[^a-z0-9]+", "-")
    name = F.regexp_replace(F.concat(F.regexp_replace(host, "[^a-z0-9]+", "-"), F.lit("-"), path), "-+", "-")
    return F.concat(F.regexp_replace(name, "^-|-$", ""), F.lit("-"), F.substring(F.sha1(url), 1, 8))


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def unlink(text: Column) -> Column:
    return _text_udf(k.unlink, "string")(text)


def weave(text: Column, targets: dict[str, str]) -> Column:
    return _text_udf(lambda s: k.weave(s, targets), "string")(text)


def collection_slug(course: Column) -> Column:
    """A collection's name: course- and up to 63 letters, digits and .-_ in all, alphanumeric at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(course)), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    name = F.concat(F.lit("course-"), F.when(bare == "", F.lit("default")).otherwise(bare))
    return F.regexp_replace(F.substring(name, 1, 63), "[-._]+$", "")


def redact(text: Column, secrets: Column) -> Column:
    return _pair_udf(lambda t, s: None if t is None else k.redact(t, list(s) if s is not None else []), "string")(text, secrets)


def safe_prose(text: Column) -> Column:
    """One line without comments; structure signs at the start escaped."""
    line = squeeze(F.regexp_replace(text, r"(?s)<!--.*?-->", " "))
    return F.regexp_replace(line, r"^(#|-|>|\||\+|\*)", r"\\$1")


def fold_number_words(text: Column) -> Column:
    """English number words (whole words) and Thai ones (anywhere, the longest first) as digits."""
    out = F.lower(text)
    for word, digit in k.THAI_NUMBERS:
        out = F.replace(out, F.lit(word), F.lit(digit))
    for word, digit in k.NUMBER_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", digit)
    return out


def stamp(text: Column) -> Column:
    """A cue's start as HH:MM:SS."""
    m = lambda g: F.regexp_extract(text, r"(?:(\d+):)?(\d{1,2}):(\d{2})", g)
    return F.concat_ws(":", F.lpad(F.when(m(1) == "", F.lit("0")).otherwise(m(1)), 2, "0"), F.lpad(m(2), 2, "0"), m(3))


def cost_text(cost: Column) -> Column:
    return F.when(cost.isNull(), F.lit("n/a")).otherwise(F.format_string("$%.4f", cost))


def chunks_of(text: Column, size: int = 24) -> Column:
    """A text cut into pieces of ``size`` characters."""
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int"))
    return F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def is_subsequence(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` occurs in ``outer`` in order (gaps allowed)."""
    step = lambda at, x: F.when((at < F.size(inner)) & (x == F.get(inner, at)), at + 1).otherwise(at)
    return F.aggregate(outer, F.lit(0), step) == F.size(inner)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def band(value: Column, bands: list[tuple[int, int]]) -> Column:
    """The label low-high of the band a relevance falls in."""
    cases = [F.when((value >= lo) & (value <= hi), F.lit(f"{lo}-{hi}")) for lo, hi in bands]
    return F.coalesce(*cases)


def verdict_cell(cell: Column) -> Column:
    """agree, disagree, unfilled or unrecognised by the first word."""
    word = F.regexp_replace(F.lower(F.get(pieces(F.trim(cell)), F.lit(0))), "[.,;:!?\\-–—]+$", "")
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", F.lit("unfilled")).when(word.isin("agree", "disagree"), word).otherwise(F.lit("unrecognised"))


def has_attempt(text: Column) -> Column:
    """Whether a message has anything to grade."""
    ends = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    bare = F.translate(F.lower(F.btrim(ends, F.lit(k._EDGE))), "ſ", "s")
    return ~F.regexp_replace(bare, SPACE + "+", " ").isin(*sorted(k.NO_ATTEMPT))


def check_answer(attempt: Column, key: Column) -> Column:
    """correct, incorrect or null, with the reason."""
    return _check(attempt, key)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(_struct(verdict=T.StringType(), reason=T.StringType()))
def _check(attempt: pd.Series, key: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([k.check(a, b) for a, b in zip(attempt, key)], columns=["verdict", "reason"])


def find_leaks(text: Column, secret: Column) -> Column:
    return _pair_udf(k.leaks, "array<string>")(text, secret)


@F.pandas_udf(_struct(variable=T.StringType(), num=T.LongType(), den=T.LongType()))
def final_answer(text: pd.Series) -> pd.DataFrame:
    """Variable and exact value on which an attempt ends."""
    found = [k.final_answer(t) for t in text]
    return pd.DataFrame({"variable": [v for v, _ in found], "num": pd.array([None if x is None else x.numerator for _, x in found], dtype="Int64"), "den": pd.array([None if x is None else x.denominator for _, x in found], dtype="Int64")})


def exact_numbers(text: Column, words: bool = False) -> Column:
    """Numbers of a text as reduced num/den strings."""
    return _text_udf(lambda s: [str(v) for v in k.numbers(s, words)], "array<string>")(text)
