"""Concept maps that a model proposes: concepts batch by batch with a carried roster, then edges between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import concepts as cs
from ..operators.ordering import numbered
from ..operators.segment import batches
from ..providers import Completion
from ..session import cut
from .cached import cached_stage

CONCEPTS_SYSTEM = 'Name the concepts that the passage teaches as {"concepts": [{"id", "name", "name_th"}]}. Use the roster\'s name for a concept that it lists.'
EDGES_SYSTEM = 'Relate concepts of the roster as the passage does: {"edges": [{"from_id", "to_id", "relation"}]}.'
_CONCEPTS = "concepts array<struct<id:string,name:string,name_th:string>>"
_EDGES = "edges array<struct<from_id:string,to_id:string,relation:string>>"


@dataclass
class Proposed:
    """``nodes``: course, label, name, name_th; ``edges``: course, source, target, relation, batch, place;
    ``report``: course, code, severity, batch, place, detail; ``calls``: the attempts that were made."""

    nodes: DataFrame
    edges: DataFrame
    report: DataFrame
    calls: DataFrame


def _passages(chunks: DataFrame, budget: int) -> DataFrame:
    """``course, batch, passage``: each course's chunks in order, as many as the budget allows under one prompt."""
    dealt = batches(chunks, budget, "course").select("course", "ordinal", F.dense_rank().over(Window.partitionBy("course").orderBy("batch")).alias("batch"))
    unit = F.struct("ordinal", F.concat(F.lit("=== "), F.coalesce("chunk_id", F.lit("")), F.lit("\n"), "text").alias("t"))
    units = chunks.join(dealt, ["course", "ordinal"]).groupBy("course", "batch").agg(F.array_sort(F.collect_list(unit)).alias("us"))
    return units.select("course", "batch", F.array_join(F.transform("us", lambda u: u["t"]), "\n\n").alias("passage"))


def _labelled(nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """Nodes with their course and its label for them: C001 and on, in order of first mention."""
    place = F.row_number().over(Window.partitionBy("course").orderBy("canonical"))
    return nodes.join(homes.select(F.col("pos").alias("first"), "course"), "first").select("course", F.format_string("C%03d", place).alias("label"), "name", "name_th", "canonical")


def _prompts(passages: DataFrame, labelled: DataFrame, how: str) -> DataFrame:
    """Adds ``prompt``: the course's roster before the passage.  A roster is one text, as every prompt holds it whole."""
    line = F.struct("canonical", F.concat_ws(" | ", "label", "name", F.coalesce("name_th", F.lit("-"))).alias("t"))
    rosters = labelled.groupBy("course").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("roster"))
    head = F.concat(F.lit("Roster\n"), F.coalesce("roster", F.lit("none yet")), F.lit("\n\nPassage\n"))
    return passages.join(rosters, "course", how).withColumn("prompt", F.concat(head, "passage"))


def _resolved(ends: DataFrame, labelled: DataFrame, tokens: DataFrame, key) -> DataFrame:
    """``course, raw, label``: what each end names, by label, else by a concept's own id, else by name; null if nothing."""
    keyed = ends.withColumns({"_id": cs.scoped("course", F.col("raw")), "_key": cs.scoped("course", key(F.col("raw")))})
    labels = labelled.select("course", F.col("label").alias("raw"), F.col("canonical").alias("_a"))
    ids, names = (tokens.filter(F.col("kind") == kind).select(F.col("token").alias(on), F.col("canonical").alias(to)) for kind, on, to in (("id", "_id", "_b"), ("key", "_key", "_c")))
    met = keyed.join(labels, ["course", "raw"], "left").join(ids, "_id", "left").join(names, "_key", "left")
    return met.select("course", "raw", F.coalesce("_a", "_b", "_c").alias("canonical")).join(labelled.select("canonical", "label"), "canonical", "left").select("course", "raw", "label")


def _with_end(edges: DataFrame, known: DataFrame, end: str, name: str) -> DataFrame:
    """Adds an end's label.  Both sides are sorted, so that adaptive execution can split a concept that most edges name."""
    return edges.join(known.select("course", F.col("raw").alias(end), F.col("label").alias(name)).hint("merge"), ["course", end])


def propose_map(chunks: DataFrame, provider: Completion, path: str, relations: Sequence[str], budget: int = 2500, courses: DataFrame | None = None, model: str = "default", key=tx.plain_text) -> Proposed:
    """A draft map for each course of ``course, ordinal, chunk_id, text`` chunks, with what went wrong.

    Pass one asks for the concepts of each batch, in order, with the roster of what
    the course's earlier batches named.  The k-th batches of all courses are one
    round, so rounds grow with the longest course only; the roster is a table.
    Pass two asks for edges, all batches at once against the final roster.  Replies are
    kept at ``path``: a run that died goes on where it stopped, to the same map.

    Codes: KX001 a course (of ``courses``) without chunks, KX002 and KX004 a batch whose
    concepts or edges could not be had, KX003 no concepts, all errors; warnings are KX101 a
    concept without a name, KX102 an edge with an end that names nothing, KX103 one
    from a concept to itself, KX104 a repeat.  A reply with another relation or a
    missing end is refused whole.  A null course is the course '', a null text is empty;
    ``ordinal`` is unique within a course; further columns are ignored.
    """
    spark = chunks.sparkSession
    named = lambda df: F.coalesce(df["course"].cast("string"), F.lit(""))
    given = cut(chunks.select(named(chunks).alias("course"), "ordinal", F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")))
    passages = cut(_passages(given, budget))
    present = passages.select("course").distinct()
    wanted = present if courses is None else courses.select(named(courses).alias("course")).distinct()

    def note(df: DataFrame, code: str, detail=F.lit(None)) -> DataFrame:
        place = [F.col(c) if c in df.columns else F.lit(None) for c in ("batch", "place")]
        return df.select("course", F.lit(code).alias("code"), place[0].cast("int").alias("batch"), place[1].cast("int").alias("place"), detail.cast("string").alias("detail"))

    notes = [note(wanted.join(present, "course", "left_anti"), "KX001")]
    calls: list[DataFrame] = []
    tokens, nodes = cs.empty_store(spark)
    homes = spark.createDataFrame([], "pos long, course string")
    labelled = _labelled(nodes, homes)
    start = 0
    for k in range(1, (passages.agg(F.max("batch")).first()[0] or 0) + 1):
        asked = _prompts(passages.filter(F.col("batch") == k), labelled, "left")
        results, made = cached_stage(asked, path, "concepts", provider, "prompt", "course", ("concepts",), model, CONCEPTS_SYSTEM)
        calls.append(made)
        replies = cut(results.select("course", F.lit(k).alias("batch"), F.from_json("result", _CONCEPTS)["concepts"].alias("cs")))
        notes.append(note(replies.filter("cs is null"), "KX002"))
        said = replies.select("course", "batch", F.posexplode("cs").alias("place", "c")).select("course", "batch", "place", F.col("c.id").alias("raw_id"), "c.name", "c.name_th")
        said = cut(numbered(said, "course", "place", name="pos", start=start))
        last = said.agg(F.max("pos")).first()[0]
        if last is None:
            continue
        start = last + 1
        assigned, tokens, nodes = cs.consolidate_concepts(said, tokens, nodes, key, by="course")
        notes.append(note(said.join(assigned.filter("canonical is null"), "pos", "left_semi"), "KX101", F.col("raw_id")))
        homes = homes.unionByName(said.select("pos", "course"))
        labelled = cut(_labelled(nodes, homes))

    notes.append(note(present.join(labelled.select("course").distinct(), "course", "left_anti"), "KX003"))
    asked = _prompts(passages, labelled, "inner").withColumn("address", F.to_json(F.struct("course", "batch")))
    results, made = cached_stage(asked, path, "edges", provider, "prompt", "address", ("edges",), model, EDGES_SYSTEM)
    calls.append(made)
    at = F.from_json("address", "course string, batch int")
    replies = results.select(at["course"].alias("course"), at["batch"].alias("batch"), F.from_json("result", _EDGES)["edges"].alias("es"))
    sound = F.forall("es", lambda e: F.coalesce(e["relation"].isin(*relations) & e["from_id"].isNotNull() & e["to_id"].isNotNull(), F.lit(False)))
    replies = cut(replies.withColumn("es", F.when(sound, F.col("es"))))
    notes.append(note(replies.filter("es is null"), "KX004"))
    raw = replies.select("course", "batch", F.posexplode("es").alias("place", "e")).select("course", "batch", "place", "e.*")
    ends = raw.select("course", F.explode(F.array("from_id", "to_id")).alias("raw")).distinct()
    known = cut(_resolved(ends, labelled, tokens, key))
    judged = cut(_with_end(_with_end(raw, known, "from_id", "source"), known, "to_id", "target"))
    told = F.concat("from_id", F.lit(" -"), "relation", F.lit("-> "), "to_id")
    good = judged.filter("source is not null and target is not null and source <> target")
    edges = cut(good.groupBy("course", "source", "target", "relation").agg(F.min(F.struct("batch", "place")).alias("at")).select("course", "source", "target", "relation", "at.batch", "at.place"))
    notes.append(note(judged.filter("source is null or target is null"), "KX102", told))
    notes.append(note(judged.filter("source = target"), "KX103", told))
    notes.append(note(good.join(edges.select("course", "batch", "place"), ["course", "batch", "place"], "left_anti"), "KX104", told))
    report = reduce(DataFrame.unionByName, notes).withColumn("severity", F.when(F.col("code") < "KX1", F.lit("error")).otherwise(F.lit("warning")))
    return Proposed(labelled.drop("canonical"), edges, report, reduce(DataFrame.unionByName, calls))
