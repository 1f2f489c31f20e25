r"""Line dedup by deletion neighbourhoods, in SQL functions only.

A line is its words; lines without words are not looked at.  A line is removed
when an earlier one, by document id (null last) and line number, has the same
words or, for lines of ``LEAST_WORDS`` or more, differs by one word inserted,
left out or exchanged (an edit in five words at most: similarity 0.8).

1. Equal lines are summed up by a 128-bit hash to their first occurrence.
2. Within one edit of each other, two lines share their first or their last
   half.  Lines whose halves occur in no other line emit nothing further; of the
   rest the first occurrence is read again, through a bitmap of fixed size, so
   that the text of other lines is never shuffled.
3. The others emit all variants with one word deleted, and themselves, as
   hashed keys.  Lines that exchange a word share a variant at the same place;
   a line with a word more has a variant that equals the shorter line.  So a
   key's group needs no pairs: its members are all compared with its earliest.
4. The proposed pairs are verified on their words.

Documents are split, spaced and hashed once: numbers only, a row per line, are
written to the shared folder, and all later steps but 2 read those.

Lines are judged on the input, not on what is left.  Rows that repeat both id
and text are one document and give one row.  Null and empty texts give a row
with no lines; an empty table gives none; extra columns are ignored.  A very long
line costs three variants per word; a very long text is split by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import join_hubs
from .storage import cut, kept

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 5
#: Bits of the filter through which lines are read again: at most 2**20 rows of 64 bits, whatever the input.
FILTER_BITS = 26


def _spaced(line: Column) -> Column:
    """One space between words, none at the ends; lines that are so already are only searched."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def _spot() -> Column:
    """A hash of where a line is."""
    return F.xxhash64("doc_id", "text_key", "line_no")


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of numbers per line with words, and one for each text's first line in any case (``h1`` null if blank).

    Lines are taken with one space between words; equal ones have equal
    hashes.  The rows are written and read back.
    """
    row = _rows(docs, id_col, text_col)
    # spaced before they are dealt out: a filter on the line then doesn't do that work again
    spaced = F.transform(F.split("text", "\n"), lambda x: F.nullif(_spaced(x), F.lit("")))
    each = row.select("doc_id", "text_key", F.posexplode(spaced).alias("line_no", "line")).filter("line is not null or line_no = 0")
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    there = F.col("line").isNotNull()
    sized = each.withColumns({"h1": F.when(there, F.xxhash64("line")), "h2": F.when(there, F.xxhash64(F.lit(1), "line")), "n": words})
    return kept(sized.select("doc_id", "text_key", "line_no", _place().alias("place"), "h1", "h2", "n", *[F.when(there, k).alias(f"k{i}") for i, k in enumerate(_halves())]), "lines")


def _place() -> Column:
    """A number that orders lines: ids from 0 up, null above all, then 31 bits of the text's hash and 30 of the line number."""
    shifted = "coalesce(cast(doc_id as decimal(38,0)) + 9223372036854775808BD, 18446744073709551616BD)"
    return F.expr(f"cast(({shifted} * 2147483648BD + pmod(text_key, 2147483648)) * 1073741824BD + line_no as decimal(38,0))")


def _halves() -> list[Column]:
    """Keys of which a line of ``n`` words shares one with every line within one edit."""

    def of(a: str) -> list[Column]:
        head, tail = f"cast(floor(({a}) / 2) as int)", f"cast(({a}) - floor(({a}) / 2) as int)"
        return [F.xxhash64(F.lit(0), F.expr(f"substring_index(line, ' ', {head})")), F.xxhash64(F.lit(1), F.expr(f"substring_index(line, ' ', -{tail})"))]

    return [*of("n"), *of("n - 1")]


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one word at most: common ends cover all but one."""

    def common(x: Column, y: Column) -> Column:
        k = F.least(F.size(x), F.size(y))
        differ = F.filter(F.sequence(F.lit(0), k), lambda i: (i == k) | (F.get(x, i) != F.get(y, i)))
        return F.get(differ, F.lit(0))

    longest = F.greatest(F.size(a), F.size(b))
    near = F.abs(F.size(a) - F.size(b)) <= 1
    return near & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def _filtered(lines: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows of ``lines`` whose ``key`` may be in ``chosen``, by a bitmap of ``2**FILTER_BITS`` bits.

    The bitmap is built in SQL and broadcast; its size does not depend on the
    input, and rows that pass by accident are dropped by a later join.
    """
    bit = F.pmod(key, F.lit(1 << FILTER_BITS))
    word = lambda b: F.shiftright(b, 6)
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    bits = chosen.select(bit.alias("_bit")).withColumn("_word", word(F.col("_bit"))).groupBy("_word").agg(F.bit_or(mask).alias("_mask"))
    found = lines.withColumn("_bit", bit).join(F.broadcast(bits), word(F.col("_bit")) == F.col("_word"))
    return found.filter(F.col("_mask").bitwiseAND(mask) != 0).drop("_bit", "_word", "_mask")


def near_lines(rows: DataFrame, lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``h1, h2`` of distinct lines that an earlier one is within one edit of.

    ``rows`` has the texts (``_rows``), ``lines`` the distinct lines with their first ``spot`` and ``place``.
    """
    # k0 and k2 are of first halves, k1 and k3 of last ones; one hash will do here: a collision only proposes more
    keys = F.array_distinct(F.array(*[F.struct(F.lit(i % 2 == 0).alias("head"), F.col(f"k{i}").alias("half")) for i in range(4)]))
    long = lines.filter(F.col("n") >= least_words)
    halves = long.select("h1", F.explode(keys).alias("k")).select("h1", "k.head", "k.half")
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("half")
    sides = halves.join(shared, "half", "left_semi").groupBy("h1").agg(F.max("head").alias("heads"), F.min("head").alias("tails")).select("h1", "heads", (~F.col("tails")).alias("tails"))
    chosen = cut(long.select("h1", "h2", "spot", F.col("place").alias("first"), "n").join(sides, "h1"))
    each = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("spot", _spot())
    again = _filtered(each, chosen, "spot").select("spot", _spaced(F.col("line")).alias("line")).withColumn("h", F.xxhash64("line"))
    first = chosen.join(again, (chosen.spot == again.spot) & (F.col("h1") == F.col("h"))).select("h1", "h2", "first", "n", "line", "heads", "tails")
    # chained hashes of the first and of the last words, so that a variant's key costs the same at any length
    chain = lambda words: F.aggregate(words, F.array(F.lit(0).cast("long")), lambda a, w: F.concat(a, F.array(F.xxhash64(F.get(a, F.size(a) - 1), w))))
    words = F.split("line", " ")
    # a row that is repeated has its first line at one spot twice
    some = cut(first.dropDuplicates(["h1", "h2"]).withColumns({"up": chain(words), "down": chain(F.reverse(words))}))
    # kind 0: a word exchanged at a place; 1: that word left out; 2: the line itself cut there, to meet
    # a longer line's variant.  Lines that share a first half differ behind it, and the reverse.
    each = some.select("first", "h1", "n", "heads", "tails", "up", "down", F.explode(F.sequence(F.lit(0), 3 * F.col("n") + 2)).alias("j"))
    each = each.withColumn("kind", F.floor(F.col("j") / (F.col("n") + 1)).cast("int")).withColumn("at", F.col("j") % (F.col("n") + 1))
    last = F.when(F.col("kind") < 2, F.col("n") - 1).otherwise(F.col("n"))
    half = F.floor((F.col("n") - 1) / 2).cast("int")
    inside = (F.col("at") <= last) & (F.col("tails") | (F.col("at") >= half)) & (F.col("heads") | (F.col("at") <= last - (F.col("n") - 1 - half)))
    key = F.xxhash64(F.col("kind") > 0, "at", F.get("up", "at"), F.get("down", last - F.col("at")))
    variants = each.filter(inside).select("first", "h1", (F.col("kind") > 0).cast("int").alias("kind"), (F.col("kind") == 2).alias("whole"), key.alias("key"))
    low, longer = (F.col("kind") == 0) | F.col("whole"), (F.col("kind") == 1) & ~F.col("whole")
    least = variants.groupBy("kind", "key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min(F.when(low, F.col("first"))).alias("low"), F.min(F.when(longer, F.col("first"))).alias("longer")).filter("a <> b").drop("a", "b")
    met = variants.join(least, ["kind", "key"])
    # an exchanged word: the earliest of all; a word more: the whole line; a word less: the earliest longer line
    earliest = F.when((F.col("kind") == 1) & F.col("whole"), F.col("longer")).otherwise(F.col("low"))
    pairs = met.select("first", earliest.alias("other")).filter("other < first").distinct()
    own = some.select("first", "h1", "h2", F.split("line", " ").alias("a"))
    others = some.select(F.col("first").alias("other"), F.split("line", " ").alias("b"))
    verified = pairs.join(own, "first").join(others, "other").filter(one_edit(F.col("a"), F.col("b")))
    return verified.select("h1", "h2").distinct()


def judge(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, removed_lines`` for each document.

    ``removed_lines`` are the numbers (from 0) of lines to remove; exact
    repeats are counted before near ones.
    """
    every = _occurrences(docs, id_col, text_col)
    mins = [F.min(c).alias(c) for c in ("place", "n", "k0", "k1", "k2", "k3")]
    lines = kept(every.filter("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min_by(_spot(), "place").alias("spot"), *mins), "distinct-lines")
    near = cut(near_lines(_rows(docs, id_col, text_col), lines, least_words)).withColumn("near", F.lit(True))
    marked = lines.select("h1", "h2", F.col("place").alias("first"), "times").join(near, ["h1", "h2"], "left")
    here = every.select("doc_id", "text_key", "line_no", "h1", "h2", "place")
    real = join_hubs(here.filter("h1 is not null"), marked, ["h1", "h2"], "times").withColumn("real", F.lit(1))
    here = real.unionByName(here.filter("h1 is null"), allowMissingColumns=True)
    exact = F.col("first").isNotNull() & (F.col("first") != F.col("place"))
    close = F.coalesce("near", F.lit(False)) & (F.col("first") == F.col("place"))
    out = here.groupBy("doc_id", "text_key").agg(
        # a row that is repeated counts each line as often as its first
        (F.count("real") / F.count_if(F.col("line_no") == 0)).cast("long").alias("n_lines"),
        F.collect_set(F.when(exact, F.col("line_no"))).alias("exact"),
        F.collect_set(F.when(close, F.col("line_no"))).alias("close"),
    )
    return out.select("doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("close").cast("long").alias("n_near"), F.array_sort(F.concat("exact", "close")).alias("removed_lines"))


ORACLE_SQL = r"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM x),
o AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS t, len(w) AS n FROM o),
f AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM k GROUP BY t),
g AS (SELECT t, w, n, first FROM f WHERE n >= 5),
i AS (SELECT t, n, first, i, array_to_string(list_concat(w[1:i], w[i + 2:n]), ' ') AS v FROM (SELECT *, unnest(range(n)) AS i FROM g)),
sub AS (SELECT t, min(first) OVER (PARTITION BY n, i, v) < first AS near FROM i),
less AS (SELECT i.t AS long_t, i.first AS long_first, g.t AS short_t, g.first AS short_first FROM i JOIN g ON i.v = g.t),
near AS (SELECT DISTINCT t FROM (
  SELECT t FROM sub WHERE near UNION ALL SELECT long_t FROM less WHERE short_first < long_first
  UNION ALL SELECT short_t FROM less WHERE long_first < short_first)),
m AS (SELECT k.doc_id, k.line_no, f.first <> {'d': k.doc_id, 'l': k.line_no} AS exact, near.t IS NOT NULL AS close
      FROM k JOIN f ON k.t = f.t LEFT JOIN near ON k.t = near.t)
SELECT d.doc_id, count(m.line_no) AS n_lines, count(*) FILTER (WHERE m.exact) AS n_exact,
       count(*) FILTER (WHERE NOT m.exact AND m.close) AS n_near,
       coalesce(list_sort(list(CAST(m.line_no AS INTEGER)) FILTER (WHERE m.exact OR m.close)), CAST([] AS INTEGER[])) AS removed_lines
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
