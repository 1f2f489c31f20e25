"""Batch build: documents -> units -> chunks -> candidates -> nodes and gated edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, gates, graph, segment


@dataclass
class Built:
    units: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame
    pairs: DataFrame


def build(docs: DataFrame, atomize: Callable[[DataFrame], DataFrame], propose: Callable[[DataFrame, DataFrame], DataFrame], types: DataFrame, threshold: float = 0.8) -> Built:
    """All stages as one lazy plan.

    ``docs``: source, text.  ``atomize`` (chunks -> corpus, pos, title,
    definition, aliases, sources) and ``propose`` (nodes, chunks -> source,
    target, type, relevance, seq) stand for the model's stages.
    """
    units = segment.section_units(docs).withColumn("seq", F.expr("cast(substring(uid, 2) as int)"))
    chunks = segment.chunks(units)
    merged = entities.consolidate(atomize(chunks))
    nodes = entities.allocate(merged.withColumn("pos", F.col("seq")), 1).select("id", "title", "definition", "aliases", "sources", "pos", (F.size("sources") > 0).alias("grounded"))
    gated = gates.gate_edges(propose(nodes, chunks), nodes, types)
    edges = graph.canonical(gated.filter("gate is null").drop("gate", "symmetric", "scored", "dag"), types)
    names = entities.names(nodes).select("id", "name")
    return Built(units, chunks, graph.with_degree(nodes, edges), edges, gated.filter("gate is not null"), entities.candidate_pairs(names, threshold))
