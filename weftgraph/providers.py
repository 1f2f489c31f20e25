"""The boundary to generated input: protocols, a deterministic stub, validate-or-repair."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .functions import kernels as k

#: Replies that a worker gathers before it hands them on.
REPLY_BYTES = 4 << 20


class Completion(Protocol):
    """A model call: prompt in, text and token counts out."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Stub:
    """Answers that depend on the prompt's hash only, for tests and offline runs."""

    def __init__(self, answers: dict[str, str] | None = None):
        self.answers = answers or {}

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        found = next((a for key, a in self.answers.items() if key in user), None)
        digest = hashlib.sha256((system + "\0" + user).encode()).hexdigest()[:16]
        return found if found is not None else json.dumps({"digest": digest}), len(user.split()), 4

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [k.hashed_vector(t) for t in texts]


class WordStub:
    """An offline model of maps: a passage's words of six Latin letters or more are its concepts, each leads to the next of its unit."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        passage = user.split("\n\nPassage\n", 1)[-1]
        units = [re.findall("[A-Za-z]{6,}", u.partition("\n")[2]) for u in re.split(r"(?:^|\n\n)=== ", passage)[1:]]
        if '"edges"' in system:
            found = {"edges": [{"from_id": a, "to_id": b, "relation": "leads_to"} for ws in units for a, b in zip(ws, ws[1:])]}
        else:
            found = {"concepts": [{"id": "", "name": w} for ws in units for w in ws]}
        return json.dumps(found), len(user.split()), len(passage.split())


def call_stage(df: DataFrame, stage: str, provider: Completion, prompt: str, key: str, required: tuple[str, ...], attempts: int = 2, system: str = "") -> DataFrame:
    """A row per attempt: ``key, attempt_no, outcome, result, tokens``; the last one of a key is its outcome.

    A reply must be JSON (one code fence allowed) with the required keys;
    otherwise the call is repeated with the reason added.  A worker holds the prompts of
    one batch as they came, one of them as a string, and replies of ``REPLY_BYTES``.
    """

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, stage string, attempt_no int, outcome string, result string, input_tokens long, output_tokens long"
    df = df.select(key, prompt)
    names = [key, "stage", "attempt_no", "outcome", "result", "input_tokens", "output_tokens"]
    types = [to_arrow_type(df.schema[key].dataType), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for item, text in zip(b.column(0), b.column(1)):  # one text at a time becomes a string
                item, text = item.as_py(), text.as_py()
                ask = text
                for n in range(1, attempts + 1):
                    reply, used, made = provider.complete(system, ask)
                    bare = re.sub(r"^```[a-z]*\s*|\s*```$", "", reply.strip())
                    try:
                        data = json.loads(bare)
                        missing = [r for r in required if r not in data]
                        reason = f"missing {', '.join(missing)}" if missing else None
                    except ValueError as e:
                        reason = f"not JSON: {e}"[:300]
                    rows.append((item, stage, n, "invalid" if reason else "ok", None if reason else bare, used, made))
                    size += len(bare) + 100
                    if not reason:
                        break
                    ask = f"{text}\n\nThe reply was refused: {reason}"
                if size > REPLY_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 96) -> DataFrame:
    """Adds ``embedding``, in batches and input order."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found: list[list[float]] = []
            for i in range(0, len(pdf), batch):
                found += embedder.embed(list(pdf[text].iloc[i : i + batch]))
            yield pdf.assign(embedding=found)

    return df.mapInPandas(run, schema + ",embedding:array<double>")


def rate_policy(used: float, reset_s: float, waited: bool, soft: float = 0.8, hard: float = 0.95) -> str:
    """proceed, warn, wait (once in a run) or defer."""
    if used < soft:
        return "proceed"
    if used < hard:
        return "warn"
    return "defer" if waited or reset_s > 3600 else "wait"


def schema_problems(schema: dict, path: str = "$") -> list[str]:
    """Where a JSON schema leaves the supported profile: references, optional or open objects."""
    out = [f"{path}: {w} is not allowed" for w in ("$ref", "oneOf", "anyOf", "patternProperties") if w in schema]
    if schema.get("type") == "object":
        props = schema.get("properties", {})
        if set(schema.get("required", [])) != set(props):
            out.append(f"{path}: all properties must be required")
        if schema.get("additionalProperties", True) is not False:
            out.append(f"{path}: additionalProperties must be false")
        for name, sub in props.items():
            out += schema_problems(sub, f"{path}.{name}")
    if "items" in schema:
        out += schema_problems(schema["items"], f"{path}[]")
    return out


def assemble(layers: list[tuple[str, str]], secrets: list[str]) -> str:
    """Prompt layers in order; refuses when an answer key would be in it."""
    text = "\n\n".join(f"## {name}\n{body}" for name, body in layers if body.strip())
    if any(s and k.squeezed(s) and k.squeezed(s) in k.squeezed(text) for s in secrets):
        raise ValueError("the prompt holds an answer key")
    return text


Generate = Callable[[DataFrame], DataFrame]
