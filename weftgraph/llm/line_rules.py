r"""Line-first quality rules, in SQL functions only.

Each line with a word is judged by itself:

* punctuation: it fails with ten or more words and no ``.``, ``!`` or ``?``,
  with more than 0.3 symbols of ``#*$%&|<>`` per word, or with a run of two or
  more ``!`` or ``?`` for every fifth word;
* navigation: it fails with three or more ``|``, bullets or angle quotes that
  make up a fifth of its words, or with three words or fewer and no closing
  mark;
* boilerplate: it fails with a stock phrase (licences, cookies, log-in, ...)
  when it has at most 40 words.

Lines that fail are removed, and a document is rejected when more than half of
its words go with them.  Before that the base rules hold: 20 words at least,
and at most 30 % of the words in 8-word windows that occur twice in the text.

A document is one row throughout: lines, words and windows are arrays, so
nothing is shuffled and a text never leaves its row.  A null text has no words
(and fails); repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored; a share at its limit passes.  A very long text is one row's
arrays in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: fixed values: stock phrases of boilerplate lines
PHRASES = (
    "accept cookies", "all rights reserved", "click here", "copyright", "cookie policy", "enable javascript",
    "is licensed under", "licensed under", "log in", "lorem ipsum", "powered by", "privacy policy", "released under",
    "sign in", "sign up", "subscribe to", "terms of service", "terms of use",
)
BOILERPLATE = r"\b(" + "|".join(PHRASES) + r")\b"
BOILERPLATE_WORDS = 40
CLOSED = r"[.!?:;,)\]\x22'…”’»]" + SPACE + "*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _covered(hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``hashes``."""

    def near(s: Column, k: Column, h: Column) -> Column:
        return F.coalesce(F.get(s, k)["h"] == h, F.lit(False))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: near(s, k - 1, x["h"]) | near(s, k + 1, x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def union(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return total(own)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, repeated), union)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in ``window``-word windows found twice or more, the first included."""

    def windows(hashed: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashed) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)]))

    def judge(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w, window))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashed, lambda h: let(windows(h), judge)))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words fails one of the rules."""
    bars = count(line, r"[|•·»›]")
    punctuation = ((n >= 10) & ~line.rlike("[.!?]")) | (10 * count(line, SYMBOL) > 3 * n) | (5 * count(line, r"[!?]{2,}") >= n)
    navigation = ((bars >= 3) & (5 * bars >= n)) | ((n <= 3) & ~line.rlike(CLOSED))
    boilerplate = (n <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and the cleaned text for each row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_kept_words, clean_text``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    read = row.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    marked = F.transform("lines", lambda x: F.struct(x.alias("line"), count(x, WORD).alias("n")))
    kept = F.filter(marked, lambda x: ~line_fails(x["line"], x["n"]))
    counted = read.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        kept.alias("left"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = counted.withColumn("base_failed", base).withColumn("n_kept_words", total(F.transform("left", lambda x: x["n"])))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (2 * F.col("n_kept_words") >= F.col("n_words"))).alias("kept"),
        "n_kept_words", F.array_join(F.transform("left", lambda x: x["line"]), "\n").alias("clean_text"),
    )


_PHRASES_SQL = "|".join(PHRASES)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
wk AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM wk) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, unnest(lines) AS line FROM d),
lc AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              len(regexp_extract_all(line, '[|•·»›]')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
              len(regexp_extract_all(line, '[!?]{{2,}}')) AS runs FROM ln),
lk AS (SELECT rid, sum(CASE WHEN (n >= 10 AND NOT regexp_matches(line, '[.!?]')) OR 10 * symbols > 3 * n OR 5 * runs >= n
                        OR (bars >= 3 AND 5 * bars >= n)
                        OR (n <= 3 AND NOT regexp_matches(line, '[.!?:;,)\]\x22\x27…”’»][\x20\x09-\x0D]*$'))
                        OR (n <= 40 AND regexp_matches(lower(line), '\b({_PHRASES_SQL})\b')) THEN 0 ELSE n END) AS n_kept FROM lc GROUP BY rid),
b AS (SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(d.lines) - len(list_distinct(d.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lk.n_kept, 0) AS BIGINT) AS n_kept_words
      FROM d LEFT JOIN cov USING (rid) LEFT JOIN lk USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 2 * n_kept_words >= n_words AS kept, n_kept_words FROM f
"""
