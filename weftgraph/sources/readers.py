"""Inbox, text, Markdown, transcript, table and graph readers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import segment
from ..operators.ordering import numbered

#: fixed values: input kinds by extension
KINDS = {
    "txt": "text", "md": "markdown", "markdown": "markdown", "pdf": "pdf", "pptx": "pptx", "docx": "docx",
    "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image",
}
TEXT_CAP = 20 << 20
UPLOAD_CAP = 50 << 20
#: fixed value: pages of a PDF file at most
PAGE_CAP = 500


def kind_of(name: Column) -> Column:
    """Input kind by extension, ``unsupported`` for all others."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(*[F.when(ext == e, F.lit(v)) for e, v in KINDS.items()], F.lit("unsupported"))


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """``name, kind, path, length`` of the files of a folder, dotfiles left out, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(~F.col("name").startswith(".")).withColumn("kind", kind_of(F.col("name"))).orderBy("name")


def status(items: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """Outcome before conversion: too large or unsupported inputs are rows, not errors."""
    s = F.when(F.col("kind") == "unsupported", F.lit("unsupported")).when(F.col("length") > cap, F.lit("failed")).when(F.col("kind") == "image", F.lit("deferred")).otherwise(F.lit("converted"))
    reason = F.when(F.col("length") > cap, F.lit("over the size limit")).when(F.col("kind") == "unsupported", F.lit("unknown extension"))
    return items.withColumn("status", s).withColumn("reason", reason)


def urls(lines: DataFrame) -> DataFrame:
    """Addresses in first-seen order: blanks and # lines dropped, repeats once. Input: seq, value."""
    u = lines.select("seq", F.trim("value").alias("url")).filter("url <> '' and not startswith(url, '#')")
    return u.groupBy("url").agg(F.min("seq").alias("seq")).orderBy("seq")


def stems(items: DataFrame) -> DataFrame:
    """Output stems unique whatever their case: collisions get the extension, then numbers."""
    base = F.regexp_replace("name", r"\.[^.]+$", "")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    i = items.withColumn("_b", base).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lower("_b"))))
    i = i.withColumn("_s", F.when(F.col("_n") > 1, F.concat("_b", F.lit("-"), ext)).otherwise(F.col("_b")))
    i = i.withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("_s")).orderBy("name")))
    return i.withColumn("stem", F.when(F.col("_k") > 1, F.concat("_s", F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col("_s"))).drop("_b", "_n", "_s", "_k")


def texts(items: DataFrame) -> DataFrame:
    """``source, text`` of text inputs."""
    return items.filter(F.col("kind").isin("markdown", "text")).select(F.col("name").alias("source"), F.col("content").cast("string").alias("text"))


def convert(items: DataFrame, extract: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """``name, status, reason, units``: converters by kind; an error is a row. One input gives one outcome."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for name, kind, content in zip(df["name"], df["kind"], df["content"]):
                if kind not in extract:
                    rows.append((name, "unsupported", f"no converter for {kind}", []))
                    continue
                try:
                    rows.append((name, "converted", None, list(extract[kind](content))))
                except Exception as e:  # noqa: BLE001  outcomes are rows
                    rows.append((name, "failed", re.sub(r"[\x00-\x1f]+", " ", str(e))[:300], []))
            yield pd.DataFrame(rows, columns=["name", "status", "reason", "units"])

    return items.select("name", "kind", "content").mapInPandas(run, "name string, status string, reason string, units array<string>")


def pdf_pages(content: bytes) -> list[str]:
    """One unit a page (needs pypdf; pages without text stay as empty units); over ``PAGE_CAP`` pages the file fails."""
    import io

    from pypdf import PdfReader  # optional

    pages = PdfReader(io.BytesIO(content)).pages
    if len(pages) > PAGE_CAP:
        raise ValueError(f"{len(pages)} pages, over the limit of {PAGE_CAP}")
    if not pages:
        raise ValueError("no pages")
    return [(p.extract_text() or "") for p in pages]


def office_parts(content: bytes, inside: str, tag: str = "t") -> list[str]:
    """Texts of the XML parts of an office file whose names match, in number order."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > 200 << 20:
            raise ValueError("inflates beyond the limit")
        names = sorted((n for n in z.namelist() if re.fullmatch(inside, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        return ["\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + tag)) for p in ElementTree.fromstring(z.read(n)).iter() if p.tag.endswith("}p")).strip() for n in names]


def slides(content: bytes) -> list[str]:
    return office_parts(content, r"ppt/slides/slide\d+\.xml")


def document(content: bytes, block: int = 15) -> list[str]:
    """A text document in blocks of ``block`` paragraphs."""
    pars = [p for p in office_parts(content, r"word/document\.xml")[0].split("\n") if p.strip()]
    return ["\n".join(pars[i : i + block]) for i in range(0, len(pars), block)]


def sheet_blocks(cells: DataFrame) -> DataFrame:
    """Blocks of a sheet split where two or more rows are blank. Input: sheet, row, text."""
    rows = cells.filter("trim(text) <> ''")
    w = Window.partitionBy("sheet").orderBy("row")
    cut = (F.col("row") - F.lag("row").over(w) > 2).cast("int")
    b = rows.withColumn("block", F.sum(F.coalesce(cut, F.lit(0))).over(w))
    return b.groupBy("sheet", "block").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("text"))


def marked_chunks(text: str) -> list[dict]:
    """Segments under ``<!-- chunk: id | key: value -->`` marks, else Markdown sections."""
    parts = re.split(r"<!--\s*chunk:\s*(.*?)\s*-->", text or "")
    if len(parts) == 1:
        return [{"chunk_id": f"s{i + 1}", "topic": None, "source_ref": " > ".join(s["heading_path"]), "lang": None, "text": s["text"]} for i, s in enumerate(segment.sections(text or ""))]
    out = []
    for head, body in zip(parts[1::2], parts[2::2]):
        name, *rest = [x.strip() for x in head.split("|")]
        meta = dict((x.partition(":")[0].strip(), x.partition(":")[2].strip()) for x in rest)
        out.append({"chunk_id": name, "topic": meta.get("topic"), "source_ref": meta.get("source", ""), "lang": meta.get("lang"), "text": body.strip()})
    return out


def transcript(text: str, least: int = 700) -> list[tuple[str, str]]:
    """Cues of a transcript joined to ``least`` characters or more, with the first one's stamp."""
    out: list[tuple[str, str]] = []
    start, words = None, []
    for line in (text or "").splitlines():
        m = re.match(r"\[?((?:\d+:)?\d{1,2}:\d{2})(?:[.,]\d+)?\]?(\s*-->.*)?\s*(.*)", line.strip())
        if m:
            if start is not None and sum(map(len, words)) >= least:
                out.append((start, " ".join(words)))
                start, words = None, []
            parts = [int(x) for x in m[1].split(":")]
            start = start or "{:02d}:{:02d}:{:02d}".format(*([0] * (3 - len(parts)) + parts))
            line = "" if m[2] else m[3]
        if line.strip() and not re.fullmatch(r"(WEBVTT.*|\d+)", line.strip()):
            words.append(re.sub(r"<[^>]+>", "", line.strip()))
    if words:
        out.append((start or "00:00:00", " ".join(words)))
    return out


_NOTE = "struct<id: string, title: string, aliases: array<string>, definition: string, sources: array<struct<locator: string, quote: string>>, edges: array<struct<type: string, target: string, relevance: int>>, error: string>"


def parse_note(text: str | None) -> dict:
    """A note's front matter and sections; a broken one has only an error."""
    empty = {"id": None, "title": None, "aliases": [], "definition": None, "sources": [], "edges": [], "error": None}
    m = re.match(r"---\n(.*?)\n---\n(.*)", text or "", re.S)
    if not m:
        return empty | {"error": "no front matter"}
    try:
        head = yaml.load(m[1], Loader=yaml.BaseLoader) or {}
        quotes: dict[str, list[str]] = {}
        for q in re.finditer(r"^> (.*?)\s+\((\S+)\)$", m[2], re.M):
            quotes.setdefault(q[2], []).append(q[1])
        seen: dict[str, int] = {}
        sources = []
        for s in head.get("sources") or []:
            n = seen.get(s["locator"], 0)
            seen[s["locator"]] = n + 1
            own = quotes.get(s["locator"], [])
            sources.append({"locator": s["locator"], "quote": own[n] if n < len(own) else ""})
        edges = [{"type": e["type"], "target": e["target"], "relevance": int(e["relevance"]) if e.get("relevance") else None} for e in head.get("edges") or []]
        body = re.split(r"^## ", re.sub(r"^> .*$", "", m[2], flags=re.M), flags=re.M)[0]
        return empty | {"id": head["id"], "title": head["title"], "aliases": head.get("aliases") or [], "definition": body.strip(), "sources": sources, "edges": edges}
    except Exception as e:  # noqa: BLE001  broken notes are rows
        return empty | {"error": f"{type(e).__name__}: {e}"[:300]}


def notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Notes of a folder and its problems (parse errors, repeated ids)."""

    @F.pandas_udf(_NOTE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_note(t) for t in s])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), run("value").alias("n")).select("file", "n.*")
    once = raw.filter("error is null").withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("file")))
    problems = raw.filter("error is not null").select("file", F.col("error").alias("reason")).unionByName(once.filter("_k > 1").select("file", F.concat(F.lit("duplicate id "), "id").alias("reason")))
    return once.filter("_k = 1").drop("_k", "error"), problems


def note_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of notes."""
    nodes = numbered(found.select("id", "title", "aliases", "definition", F.exists("sources", lambda s: s["quote"] != "").alias("grounded")), "id", name="pos")
    e = found.select(F.col("id").alias("source"), F.posexplode("edges").alias("k", "e"))
    return nodes, e.select("source", "e.target", "e.type", "e.relevance", F.xxhash64("source", "k").alias("seq"))


def index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an index file; dangling edges are dropped."""
    from ..operators.graph import drop_dangling

    raw = spark.read.json(path, multiLine=True)
    n = raw.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*").withColumn("grounded", F.exists("sources", lambda s: F.coalesce(s["quote"], F.lit("")) != ""))
    e = raw.select(F.posexplode("edges").alias("seq", "e")).select("seq", "e.*")
    return n, drop_dangling(e, n)


def table_rows(path: str, required: tuple[str, ...], rows: str = "rows") -> tuple[list[dict], list[str]]:
    """Rows of a YAML table and all of its problems (missing keys, repeated or empty ids)."""
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    found = data.get(rows) or []
    problems = [f"row {i}: {key} is missing" for i, r in enumerate(found) for key in required if key not in r]
    ids = [r.get("id") for r in found]
    problems += [f"id {i} is repeated" for i in sorted({i for i in ids if i and ids.count(i) > 1})]
    problems += [f"row {i}: empty id" for i, x in enumerate(ids) if not x]
    return found, problems


def table_version(path: str) -> str:
    """Declared version and content hash of a table file."""
    import hashlib

    with open(path, "rb") as f:
        raw = f.read()
    return f"{(yaml.safe_load(raw) or {}).get('version', '0')}+{hashlib.sha256(raw).hexdigest()[:12]}"


def dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON Lines set; ``limit`` takes the first lines (an option of the reader)."""
    d = spark.read.json(path)
    return d.limit(limit) if limit else d


def resolve_locators(locators: DataFrame, units: DataFrame) -> DataFrame:
    """Whether ``file#page=``, ``#lines=a-b`` or ``#heading=`` exist. units: file, lines, pages, headings."""
    part = lambda p, g=1: F.regexp_extract("locator", p, g)
    j = locators.withColumn("file", part(r"^([^#]*)")).join(units, "file", "left")
    page, a, b = part(r"#page=(\d+)").try_cast("int"), part(r"#lines=(\d+)-(\d+)").try_cast("int"), part(r"#lines=(\d+)-(\d+)", 2).try_cast("int")
    head = part(r"#heading=(.*)$")
    ok = F.when(F.col("locator").contains("#page="), page.between(1, F.col("pages"))).when(F.col("locator").contains("#lines="), (a >= 1) & (a <= b) & (b <= F.col("lines"))).when(F.col("locator").contains("#heading="), F.array_contains("headings", head)).otherwise(F.col("lines").isNotNull())
    return j.select("locator", F.coalesce(ok, F.lit(False)).alias("resolves"))


def parse_json(text: Column, schema: str) -> Column:
    """JSON with one code fence stripped; what does not fit gives nulls."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def review_table(text: str) -> list[list[str]]:
    """Rows of a Markdown table; cells beyond the header's are joined to the last."""
    rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in text.splitlines() if line.strip().startswith("|")]
    rows = [r for r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    if not rows:
        return []
    n = len(rows[0])
    return [r[: n - 1] + [" | ".join(r[n - 1 :])] if len(r) > n else r + [""] * (n - len(r)) for r in rows]


def map_file(path: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a course map file."""
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return data.get("nodes") or [], [{"source": e.get("from"), "target": e.get("to"), "type": e.get("relation")} for e in data.get("edges") or []]


def map_report(path: str) -> tuple[list[dict], list[dict], list[tuple[str, str, str]]]:
    """Well-formed nodes and edges of a course map file, and ``code, severity, location`` of what is not.

    KL000 unreadable file, KL001 missing field or no list, KL002 malformed node,
    KL004 malformed edge.  Nothing is raised; ``gates.validate_map`` finds the rest.
    """
    found: list[tuple[str, str, str]] = []
    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return [], [], [("KL000", "error", "")]
    data = {} if data is None else data
    if not isinstance(data, dict):
        return [], [], [("KL000", "error", "")]
    told = lambda x: isinstance(x, str) and bool(x.strip())
    found += [("KL001", "error", key) for key in ("course_id", "course_name") if not told(data.get(key))]
    lists = {}
    for key in ("nodes", "edges"):
        lists[key] = data.get(key) or []
        if not isinstance(lists[key], list):
            found.append(("KL001", "error", key))
            lists[key] = []
    nodes, edges = [], []
    for i, x in enumerate(lists["nodes"]):
        if isinstance(x, dict) and told(x.get("id")) and isinstance(x.get("name"), str):
            nodes.append(x)
        else:
            found.append(("KL002", "error", f"nodes[{i}]"))
    for i, x in enumerate(lists["edges"]):
        if isinstance(x, dict) and isinstance(x.get("from"), str) and isinstance(x.get("to"), str):
            edges.append({"source": x["from"], "target": x["to"], "type": x.get("relation")})
        else:
            found.append(("KL004", "error", f"edges[{i}]"))
    return nodes, edges, found


#: fixed value: normalised characters of an alias at least
ALIAS_CHARS = 3
#: fixed values: a gloss in brackets, what joins the parts of a list, what parts a head from the rest
_GLOSS, _JOINED, _OF = r"\(([^()]*)\)", r"(?i)\s+(?:and|vs\.?)\s+|\s*/\s*|\s*&\s*", r"(?i)\s+of\s+"


def _label_parts(name: str) -> Iterator[tuple[str, int]]:
    """Parts of a label and the least words each needs, the preferred spelling first."""
    glosses = re.findall(_GLOSS, name)
    for phrase in (*glosses, re.sub(_GLOSS, " ", name)):
        sides = re.split(_OF, phrase, maxsplit=1)
        yield phrase, 1
        for whole, least in ((phrase, len(sides)), *((head, 2) for head in sides[:-1])):
            listed = re.split(_JOINED, whole)
            yield from ((part, least) for part in ([whole] if whole is not phrase else []) + listed)


def derived_aliases(name: str) -> list[str]:
    """What else a label may be called: its glosses, itself without them, the parts of a list and what stands
    before "of"; parts of a label with "of" only where they have two words or more."""
    first: dict[str, str] = {}
    for part, least in _label_parts(name):
        trimmed = part.strip(" ,;:-")
        key = k.plain_text(trimmed)
        if len(key) >= ALIAS_CHARS and key.count(" ") + 1 >= least:
            first.setdefault(key, trimmed)
    first.pop(k.plain_text(name), None)
    return list(first.values())


def topic_labels(topics: list[dict]) -> list[tuple[str, int, str, str]]:
    """``topic_id, seq, label, kind``: names, ids, given and derived aliases, normalised."""
    out = []
    for seq, t in enumerate(topics):
        names = {k.plain_text(t["name"]): "name"}
        for a in [*(t.get("aliases") or []), *filter(None, [t.get("name_th")]), *derived_aliases(t["name"]), t["id"]]:
            names.setdefault(k.plain_text(a), "alias")
        out += [(t["id"], seq, label, kind) for label, kind in names.items() if label]
    return out


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
