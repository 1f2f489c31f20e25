"""Registry of concepts, candidate pairs and consolidation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import text as tx
from ..session import cut
from .components import connected_components, join_spread
from .ordering import numbered


def names(nodes: DataFrame, key=tx.norm_title) -> DataFrame:
    """``id, name, tier``: titles (0) and aliases (1), normalised."""
    t = nodes.select("id", key(F.col("title")).alias("name"), F.lit(0).alias("tier"), "pos")
    a = nodes.select("id", F.explode("aliases").alias("a"), "pos").select("id", key(F.col("a")).alias("name"), F.lit(1).alias("tier"), "pos")
    return t.unionByName(a).filter("name <> ''")


def lookup(drafts: DataFrame, registry: DataFrame) -> DataFrame:
    """``draft_id, id``: the first active row whose title meets a draft's title or alias, or whose alias meets its title."""
    have = names(registry.filter("status = 'active'")).select(F.col("id"), "name", F.col("tier").alias("theirs"), F.col("pos").alias("row"))
    want = names(drafts).select(F.col("id").alias("draft_id"), "name", F.col("tier").alias("ours"))
    met = want.join(have, "name").filter("ours + theirs < 2")
    return met.groupBy("draft_id").agg(F.min_by("id", "row").alias("id"))


def candidate_pairs(items: DataFrame, threshold: float = 0.5, focus: Column | None = None, side: str | None = None) -> DataFrame:
    """``a_id, b_id, score`` of names at Dice similarity ``threshold`` or more, equal ones left out.

    With ``side`` only items that differ in that column are paired.

    A positive score needs a shared word or trigram, so pairs come from an
    equi-join on those: names with spaces by words, others by trigrams.  Two
    names at ``threshold`` share ``threshold / (2 - threshold)`` of either's keys,
    so each is entered under its rarest keys only, as many as leave none of
    those pairs out; a key that very many names have is hardly ever among them.
    """
    n = items.select("id", "name", (focus if focus is not None else F.lit(True)).alias("new"), (F.col(side) if side else F.col("id")).alias("side")).filter("name <> ''").distinct()
    n = n.withColumn("words", F.array_distinct(tx.pieces(F.col("name"), " ")))
    compact = F.regexp_replace("name", " ", "")
    at = F.sequence(F.lit(1), F.greatest(F.length(compact) - 2, F.lit(1)))
    n = n.withColumn("grams", F.array_distinct(F.transform(at, lambda i: F.substring(compact, i, F.lit(3))))).withColumn("solid", ~F.col("name").contains(" ") | F.col("name").rlike(tx.THAI))
    by_word, by_gram = _rare_keys(n.filter("not solid"), "words", threshold), _rare_keys(n, "grams", threshold)
    found = []
    for left, right, rule in ((by_word, by_word, "not l.solid and not r.solid"), (by_gram, by_gram, "l.solid or r.solid")):
        j = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.side") != F.col("r.side")) & (F.col("l.name") != F.col("r.name")) & (F.col("l.new") | F.col("r.new"))).filter(rule)
        score = tx.dice(F.col("l.words"), F.col("r.words")) if rule.startswith("not") else tx.dice(F.col("l.grams"), F.col("r.grams"))
        found.append(j.select(F.col("l.id").alias("a_id"), F.col("r.id").alias("b_id"), score.alias("score")))
    return found[0].unionByName(found[1]).filter(F.col("score") >= threshold).groupBy("a_id", "b_id").agg(F.max("score").alias("score"))


def _rare_keys(items: DataFrame, column: str, threshold: float) -> DataFrame:
    """``items`` with ``key``: each of the rarest elements of ``column`` that two sets at Dice ``threshold`` can't all lack."""
    each = items.select("id", "name", F.explode(column).alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "key").groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("keys"))
    shared = F.ceil(F.size("keys") * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int")
    kept = ranked.select("id", "name", F.explode(F.slice("keys", 1, F.size("keys") - F.greatest(shared, F.lit(1)) + 1)).alias("k"))
    return items.join(kept.select("id", "name", "k.key"), ["id", "name"])


def capped(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The best ``most`` pairs for judgement, and the overflow."""
    ranked = numbered(pairs, F.desc("score"), "a_id", "b_id", name="rank")
    return ranked.filter(F.col("rank") <= most), ranked.filter(F.col("rank") > most)


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts joined whichever way round they name a pair; unjudged pairs are unsure."""
    v = verdicts.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), "verdict", "seq")
    first = v.groupBy("a_id", "b_id").agg(F.min_by("verdict", "seq").alias("verdict"))
    return pairs.join(first, ["a_id", "b_id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("unsure")))


def allocate(new: DataFrame, next_seq: int, order: str = "pos") -> DataFrame:
    """Ids ``slug-0001``: numbers go on from the high-water mark and are never reused."""
    return numbered(new, order, name="_n", start=next_seq).withColumn("id", F.format_string("%s-%04d", tx.slug(F.col("title")), F.col("_n"))).drop("_n")


def consolidate(candidates: DataFrame, group: str = "corpus") -> DataFrame:
    """Candidates of one corpus merged when a title or alias meets another's title.

    Merging is in input order: the first definition wins, aliases, sources and
    flags are united in order.  A candidate that meets two earlier ones joins
    them.  Candidates that no chain of such meetings connects never touch, so
    each connected set is merged by itself; only its members meet in one task.
    Input: group, pos (unique in its group), title, definition, aliases, sources.
    """
    named = cut(candidates.withColumn("_node", F.to_json(F.struct(group, "pos"))))
    every = named.select(group, "_node", F.explode(F.concat(F.array(F.struct(F.col("title").alias("name"), F.lit(True).alias("is_title"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(False).alias("is_title"))))).alias("n"))
    keyed = every.select(group, "_node", tx.norm_title(F.col("n.name")).alias("_name"), "n.is_title")
    # who has a name is linked to the first that has it as a title
    owner = keyed.filter("is_title").groupBy(group, "_name").agg(F.min("_node").alias("b"))
    links = join_spread(keyed.select(group, "_name", F.col("_node").alias("a")), owner, [group, "_name"]).select("a", "b")
    roots = connected_components(links)
    whole = named.join(roots, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node"))
    schema = f"{group} {candidates.schema[group].dataType.simpleString()}, _pos {candidates.schema['pos'].dataType.simpleString()}, title string, definition string, aliases array<string>, sources array<string>, n_merged int"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        drafts: list[dict | None] = []
        titles: dict[str, int] = {}
        aliases: dict[str, int] = {}

        def unite(a: dict, b: dict) -> None:
            a["aliases"] += [x for x in [b["title"], *b["aliases"]] if k.title_key(x) not in {k.title_key(y) for y in [a["title"], *a["aliases"]]}]
            a["sources"] += [x for x in b["sources"] if x not in a["sources"]]
            a["n_merged"] += b["n_merged"]
            a["definition"] = a["definition"] or b["definition"]

        for row in df.sort_values("pos").to_dict("records"):
            new = {"pos": row["pos"], "title": row["title"], "definition": row["definition"], "aliases": list(row["aliases"] if row["aliases"] is not None else []), "sources": list(row["sources"] if row["sources"] is not None else []), "n_merged": 1}
            key = k.title_key(new["title"])
            met = {titles.get(key), aliases.get(key), *(titles.get(k.title_key(a)) for a in new["aliases"])} - {None}
            at = sorted(met)
            if not at:
                at = [len(drafts)]
                drafts.append(new)
            else:
                unite(drafts[at[0]], new)
                for other in at[1:]:
                    unite(drafts[at[0]], drafts[other])
                    drafts[other] = None
                    for table in (titles, aliases):
                        table.update({n: at[0] for n, d in table.items() if d == other})
            d = drafts[at[0]]
            titles.setdefault(k.title_key(d["title"]), at[0])
            for a in d["aliases"]:
                aliases.setdefault(k.title_key(a), at[0])
        out = [d for d in drafts if d]
        return pd.DataFrame({group: df[group].iloc[0], "_pos": [d["pos"] for d in out], **{c: [d[c] for d in out] for c in ("title", "definition", "aliases", "sources", "n_merged")}})

    merged = cut(whole.select(*candidates.columns, "_root").groupBy(group, "_root").applyInPandas(run, schema))
    # numbers in input order: a window over places alone
    seq = merged.select(group, "_pos").withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy("_pos")))
    return merged.join(seq, [group, "_pos"]).select(group, "seq", "title", "definition", "aliases", "sources", "n_merged")


#: Bits of the table in which runs of words are looked up (at most 2**16 rows of 64 bits are collected), and bytes hashed at once.
QUOTE_BITS, QUOTE_BYTES = 22, 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``hash, text number`` of every run of ``width`` words, one space between words: differences of sums over all bytes."""
    raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    own = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
    k = max(len(starts) - width + 1, 0)
    whole = own[:k] == own[len(own) - k :]
    begin, end = starts[:k][whole], ends[len(ends) - k :][whole]
    return (sums[end] - sums[begin]) * _powers(_INVERSE, len(raw) + 1)[begin], own[:k][whole]


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(32))) * _MIX) >> np.uint64(64 - QUOTE_BITS)).astype(np.int64)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > QUOTE_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t) + 1
    if texts:
        yield begin, texts[begin:]


def quotes_met(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, window: int = 5) -> DataFrame:
    """Rows ``quote_id, text_id, q, t`` where the text ``t`` has the quote ``q`` inside; one space between words.

    All words of a quote but the first and the last stand whole in a text that
    has it, so pairs come from an equi-join on a hash of up to ``window`` of them in a row.
    Only runs of a text that a bitmap of the quotes' hashes knows leave the scan, with
    the text, which is then searched for the quote itself.
    Quotes of one or two words have no such run and are looked for in each text.
    """
    q = quotes.filter("q is not null").select(quote_id, "q", F.split("q", " ").alias("w")).withColumn("width", F.greatest(F.lit(0), F.least(F.lit(window), F.size("w") - 2)))
    texts = texts.select(text_id, "t")
    widths = sorted(r.width for r in q.select("width").distinct().collect())  # window + 1 values at most
    found = [texts.join(q.filter("width = 0").select(quote_id, "q"), F.col("t").contains(F.col("q"))).select(quote_id, text_id, "q", "t")]
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((quotes, quote_id), (texts, text_id))}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [_runs([r.encode()], r.count(" ") + 1)[0][0] for r in b.column("run").to_pylist()]
            h = np.array(hashes, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h.view(np.int64)), pa.array(_bit(h))], names=[quote_id, "q", "key", "bit"])

    for width in [w for w in widths if w]:
        run = F.array_join(F.slice("w", 2, width), " ")
        own = q.filter(F.col("width") == width).select(quote_id, "q", run.alias("run")).mapInArrow(keyed, f"{quote_id} {kind[quote_id]}, q string, key long, bit long")
        mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
        known = np.zeros(1 << QUOTE_BITS - 6, dtype=np.int64)
        for r in own.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).collect():
            known[r.word] = r["mask"]
        table = texts.sparkSession.sparkContext.broadcast(known)

        def marked(batches: Iterator[pa.RecordBatch], width: int = width, table=table) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(table.value.view(np.uint8), bitorder="little").view(bool)
            for b in batches:
                for begin, part in _slices([t.encode() for t in b.column("t").to_pylist()]):
                    hashes, number = _runs(part, width)
                    hit = bits[_bit(hashes)]
                    pairs = np.unique(np.stack([number[hit].astype(np.int64), hashes[hit].view(np.int64)], 1), axis=0)
                    if len(pairs):
                        at, first = np.unique(pairs[:, 0], return_index=True)
                        keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)).astype(np.int32)), pa.array(pairs[:, 1]))
                        rows = b.take(pa.array(at + begin))
                        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), keys], names=[text_id, "t", "keys"])

        hits = texts.filter("t is not null").mapInArrow(marked, f"{text_id} {kind[text_id]}, t string, keys array<long>")
        met = hits.select(text_id, "t", F.explode("keys").alias("key")).join(own.drop("bit"), "key")
        found.append(met.filter(F.col("t").contains(F.col("q"))).select(quote_id, text_id, "q", "t"))
    return reduce(DataFrame.unionByName, found if 0 in widths else found[1:] or found)


def quotes_in_texts(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, window: int = 5) -> DataFrame:
    """Pairs ``quote_id, text_id`` of ``quotes_met``."""
    return quotes_met(quotes, texts, quote_id, text_id, window).select(quote_id, text_id)


def foreign_aliases(registry: DataFrame) -> DataFrame:
    """Aliases that already name another active row: ``id, alias, owner``."""
    titles = registry.filter("status = 'active'").select(F.col("id").alias("owner"), tx.norm_title(F.col("title")).alias("name"))
    a = registry.select("id", F.explode("aliases").alias("alias")).withColumn("name", tx.norm_title(F.col("alias")))
    return a.join(titles, "name").filter("id <> owner").select("id", "alias", "owner")


def retire(registry: DataFrame, ids: DataFrame, run: str | None = None) -> DataFrame:
    """Rows of ``ids`` become retired (only those of ``run`` if given); ids stay burnt."""
    own = F.lit(True) if run is None else F.col("created_run") == run
    j = registry.join(ids.select("id", F.lit(True).alias("_out")), "id", "left")
    return j.withColumn("status", F.when(F.col("_out") & own, F.lit("retired")).otherwise(F.col("status"))).drop("_out")


def replace_by_key(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Union in which the new rows win."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_arrays(df: DataFrame, by: str, column: str, order: str = "pos") -> DataFrame:
    """Ordered distinct union of an array column per key."""
    packed = F.array_sort(F.collect_list(F.struct(order, column)))
    return df.groupBy(by).agg(F.array_distinct(F.flatten(F.transform(packed, lambda x: x[column]))).alias(column))


def grounding(claims: DataFrame, units: DataFrame) -> DataFrame:
    """``verdict`` of each (claim_id, uid, quote): grounded, quote_not_found or unknown_unit."""
    u = units.select("uid", tx.squeeze(F.col("text")).alias("_text"), F.lit(True).alias("_there"))
    j = claims.join(u, "uid", "left")
    verdict = F.when(F.col("_there").isNull(), F.lit("unknown_unit")).when(F.col("_text").contains(tx.squeeze(F.col("quote"))), F.lit("grounded")).otherwise(F.lit("quote_not_found"))
    return j.withColumn("verdict", verdict).drop("_text", "_there")


def set_agreement(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """One row: common, only_in_a, only_in_b, jaccard and both overlaps of two key sets."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    j = x.join(y, key, "full_outer")
    n = j.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("common"), F.count_if(F.col("b").isNull()).alias("only_in_a"), F.count_if(F.col("a").isNull()).alias("only_in_b"))
    total = F.col("common") + F.col("only_in_a") + F.col("only_in_b")
    share = lambda d: F.when(d == 0, F.lit(0.0)).otherwise(F.col("common") / d)
    return n.select("*", F.when(total == 0, F.lit(1.0)).otherwise(F.col("common") / total).alias("jaccard"), share(F.col("common") + F.col("only_in_a")).alias("overlap_a"), share(F.col("common") + F.col("only_in_b")).alias("overlap_b"))


def start_nodes(queries: DataFrame, nodes: DataFrame, floor: float = 0.82) -> DataFrame:
    """``query_id, id, tier``: by name, by id, by containment, else by gestalt similarity of ``floor`` or more.

    Shorter names win ties, then the order of the nodes.  The node table of a
    course is a small dimension and is broadcast.
    """
    n = F.broadcast(nodes.select("id", tx.plain_text(F.col("title")).alias("name"), "pos"))
    q = queries.select("query_id", tx.plain_text(F.col("topic")).alias("q"))
    j = q.join(n, on=F.length("name") > 0).withColumn("sim", tx.gestalt(F.col("q"), F.col("name")))
    inside = F.col("q").contains(F.col("name")) | (F.col("name").contains(F.col("q")) & (F.length("q") > 0))
    tier = F.when(F.col("q") == F.col("name"), 0).when(F.col("q") == F.lower(F.col("id").cast("string")), 1).when(inside, 2).when(F.col("sim") >= floor, 3)
    w = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 3, -F.col("sim")), F.length("name"), "pos")
    return j.withColumn("tier", tier).filter("tier is not null").withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", "id", "tier")


def members(chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """``cid, draft_id`` for drafts that name a chunk."""
    d = drafts.select(F.col("id").alias("draft_id"), F.explode("chunk_ids").alias("cid"))
    return chunks.select("cid").join(d, "cid")


def first_n(df: DataFrame, by: str, order: str, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of each key, and the rest."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.filter(F.col("_k") <= n).drop("_k"), ranked.filter(F.col("_k") > n).drop("_k")


def roster(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows (a prompt's roster) with a flag whether more were left out."""
    total = df.count()
    return df.orderBy(order).limit(n).withColumn("truncated", F.lit(total > n))


def stability_problems(legs: DataFrame) -> DataFrame:
    """Why two runs can't be compared: one row per reason. legs: leg, status, corpus, model, n_nodes."""
    a = legs.agg(F.count(F.lit(1)).alias("n"), F.every(F.col("status") == "ok").alias("ok"), F.countDistinct("corpus").alias("corpora"), F.countDistinct("model").alias("models"), F.min("n_nodes").alias("least"))
    why = F.array(F.when(F.col("n") != 2, F.lit("two legs are needed")), F.when(~F.col("ok"), F.lit("a leg did not finish")), F.when(F.col("corpora") > 1, F.lit("different corpora")), F.when(F.col("models") > 1, F.lit("different models")), F.when(F.col("least") == 0, F.lit("a leg has no nodes")))
    return a.select(F.explode(F.array_compact(why)).alias("reason"))
