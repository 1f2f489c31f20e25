"""Writers: tables as Parquet, exports as JSON and Markdown."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators.ordering import numbered


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet under the committer's all-or-nothing rename."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def append_rejects(df: DataFrame, path: str) -> None:
    """Rejected edges, append-only JSON lines."""
    df.write.mode("append").json(path)


def write_files(files: dict[str, str]) -> None:
    """Several small files, each staged beside its place and renamed."""
    staged = []
    for path, text in files.items():
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        staged.append((tmp, path))
    for tmp, path in staged:
        os.replace(tmp, path)


def index_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one JSON document per node, sorted by id, with its edges."""
    e = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target", "type", "relevance"))).alias("edges"))
    return nodes.join(e, "id", "left").orderBy("id").select(F.to_json(F.struct("*")).alias("value"))


def render_note(note: dict, targets: dict[str, str]) -> str:
    """A note as text: the same bytes for the same content."""
    lines = ["---", f"id: {note['id']}", f"title: {json.dumps(note['title'], ensure_ascii=False)}", f"aliases: {json.dumps(note.get('aliases') or [], ensure_ascii=False)}"]
    lines += ["sources:" if note.get("sources") else "sources: []"] + [f"  - locator: {json.dumps(s['locator'])}" for s in note.get("sources") or []]
    lines += ["edges:" if note.get("edges") else "edges: []"]
    for e in note.get("edges") or []:
        lines += [f"  - type: {e['type']}", f"    target: {e['target']}"] + ([f"    relevance: {e['relevance']}"] if e.get("relevance") is not None else [])
    body = k.weave(re.sub(r"\s+", " ", note.get("definition") or "").strip(), targets, note["id"])
    quotes = [f"> {re.sub(r'\s+', ' ', s['quote']).strip()} ({s['locator']})" for s in note.get("sources") or [] if s.get("quote")]
    return "\n".join([*lines, "---", body, "", *quotes]) + "\n"


def review_queue(pairs: DataFrame) -> DataFrame:
    """Unsure pairs for review, best first."""
    return numbered(pairs.filter("verdict = 'unsure'"), F.desc("score"), "a_id", "b_id", name="rank")


def report(totals: dict, secrets: list[str]) -> str:
    """A run report as JSON; refuses to hold a credential."""
    text = json.dumps(totals, sort_keys=True, default=str)
    clean = k.redact(text, secrets)
    if any(s and s in clean for s in secrets):
        raise ValueError("a credential is left in the report")
    return clean


def html_view(nodes: list[dict], edges: list[dict]) -> str:
    """A page with the graph as escaped JSON."""
    payload = json.dumps({"nodes": nodes, "edges": edges}, sort_keys=True).replace("<", "\\u003c")
    return f'<!doctype html><meta charset="utf-8"><title>graph</title><script type="application/json" id="graph">{payload}</script>'


def drop_partition(df: DataFrame, path: str, course: str, to: str) -> None:
    """A copy of a collection without one course."""
    df.filter(F.col("course_id") != course).write.mode("overwrite").parquet(to)


def import_edges(edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges under another vocabulary (first direction of a pair wins) and what could not be mapped."""
    from ..operators.gates import first_direction

    j = edges.join(F.broadcast(mapping), "type", "left")
    good = j.filter("relation is not null").select("source", "target", F.col("relation").alias("type"), "seq")
    return first_direction(good), j.filter("relation is null").select("source", "target", "type")


def write_map(path: str, nodes: list[dict], edges: list[dict]) -> None:
    """A course map as YAML, replaced in one step."""
    import yaml

    write_files({path: yaml.safe_dump({"nodes": nodes, "edges": [{"from": e["source"], "to": e["target"], "relation": e["type"]} for e in edges]}, allow_unicode=True, sort_keys=False)})


def rag_rows(nodes: DataFrame, course: str) -> DataFrame:
    """A graph's nodes as chunks of a course."""
    return nodes.filter("definition <> ''").select(F.lit(course).alias("course_id"), F.col("id").alias("chunk_id"), F.concat("title", F.lit("\n"), "definition").alias("text"), F.concat(F.lit("graph#"), F.col("id").cast("string")).alias("source_ref"))


def deep_replace(value, pairs: dict[str, str]):
    """Strings replaced everywhere in a nested value."""
    if isinstance(value, str):
        for a, b in pairs.items():
            value = value.replace(a, b)
        return value
    if isinstance(value, dict):
        return {k_: deep_replace(v, pairs) for k_, v in value.items()}
    return [deep_replace(v, pairs) for v in value] if isinstance(value, list) else value


def safe_name(name: str) -> bool:
    """Whether a name is one path segment that stays where it is put."""
    return bool(re.fullmatch(r"[\w][\w.\- ]{0,127}", name)) and ".." not in name and not name.endswith((".", " "))


def reason_line(text: str, most: int = 300) -> str:
    """One printable line of at most ``most`` characters."""
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]", " ", text)).strip()[:most]
