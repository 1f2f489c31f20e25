r"""License scan by a positional index of rare words.

Words are runs of letters, digits and characters beyond ASCII, lower-cased
(A-Z only).  Licence templates are word sequences with mandatory key phrases;
the index holds, for every word of theirs, its postings (template, position).
How rare a word is comes from its document frequency over all documents.

For a file and a template all of whose mandatory words the file has, the
``ANCHORS`` words of highest inverse document frequency among the template's
words in the file are looked up: each place of such a word and each posting
give a relative position, and positions that two of the words agree on (within
``SLIP`` words) are where the template may lie.  There every mandatory phrase
must stand word for word, and the template's share is what part of its words,
weighted by rarity, lies where it should; from ``SHARE`` on the file has the label.
The base phrases are templates that are mandatory as a whole: all places of a
phrase are found from its rarest word and its neighbours' relative positions.

Only the counts of the templates' words (some hundreds) reach the driver, and the
index is sent to the tasks; texts are read twice and never shuffled.

Null and empty texts have no words, empty labels and score 0; rows that repeat are
scanned alike; a null id stays; an empty table gives no rows; extra columns are
ignored.  Of places where a template fits equally well the first is reported.  A very
long text takes some 60 bytes a byte while its task looks through it; no place,
word or candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import words

#: Highest-IDF words of a template that are looked up in a file.
ANCHORS = 4
#: Words by which a place may be off its relative position.
SLIP = 2
#: Least weighted share of a template.
SHARE = 0.6
#: fixed values: phrases whose every place counts
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: fixed values: label, wording, and the phrases of the wording that must stand word for word
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    ("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    ("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "any later version")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software", "specific prior written permission")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
)
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


class Library:
    """Templates as positions of numbered words, and the numbers of the words of texts."""

    def __init__(self, templates: tuple = TEMPLATES, base: tuple = BASE):
        wording = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in templates]
        phrases = [(label, text.split()) for label, text in base]
        self.words = sorted({w for _, text, _ in wording for w in text} | {w for _, text in phrases for w in text})
        number = {w: k for k, w in enumerate(self.words)}
        buf = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        s, e, _ = words.spans(buf, np.array([0, len(buf)]))
        self.index = words.Index(words.word_hashes(buf, s, e))
        ids = lambda ws: np.array([number[w] for w in ws])
        self.base = [(label, ids(text)) for label, text in phrases]
        self.templates = [(label, ids(text), [(_where(text, k), ids(k)) for k in keys]) for label, text, keys in wording]
        self.mandatory = np.zeros((len(wording), len(self.words)), np.float32)
        for row, (_, _, keys) in zip(self.mandatory, self.templates):
            for _, key in keys:
                row[key] = 1

    def numbered(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number (-1: in no template), and each text's first word."""
        raw, off = words.text_buffer(column)
        s, e, first = words.spans(raw, off, _OUTSIDE)
        return self.index.find(words.word_hashes(words.LOWER[raw], s, e)), first

    def present(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which of the templates' words each text has."""
        has = np.zeros((len(first) - 1, len(self.words)), bool)
        at = np.flatnonzero(ids >= 0)
        has[np.searchsorted(first, at, "right") - 1, ids[at]] = True
        return has


def _where(text: list[str], key: list[str]) -> int:
    return next(k for k in range(len(text)) if text[k : k + len(key)] == key)


def _places(ids: np.ndarray, phrase: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Where a phrase stands: from each place of its rarest word, by the others' relative positions."""
    rarest = int(np.argmax(idf[phrase]))
    start = np.flatnonzero(ids == phrase[rarest]) - rarest
    start = start[(start >= 0) & (start + len(phrase) <= len(ids))]
    for k, word in enumerate(phrase):
        start = start[ids[start + k] == word]
    return start


def _fits(ids: np.ndarray, text: np.ndarray, keys: list, places: list[np.ndarray], idf: np.ndarray) -> tuple[float, int] | None:
    """The best share of a template in one file and the word where it begins."""
    have = np.unique(text)
    have = have[np.isin(have, ids)]
    rare = have[np.argsort(-idf[have], kind="stable")][:ANCHORS]
    offsets = [np.unique(np.flatnonzero(ids == w)[:, None] - np.flatnonzero(text == w)) for w in rare]
    start = np.unique(np.concatenate(offsets))
    near = lambda sorted_at, lo, hi: np.searchsorted(sorted_at, hi, "right") > np.searchsorted(sorted_at, lo)
    agree = np.sum([near(o, start, start + SLIP) for o in offsets], axis=0)
    start = start[agree >= min(2, len(rare))]
    for (at, _), found in zip(keys, places):
        start = start[near(found, start + at - SLIP, start + at + 2 * SLIP)]
    if not len(start):
        return None
    weight = idf[text]
    there = np.zeros((len(start), len(text)), bool)
    for slip in range(-SLIP, 2 * SLIP + 1):
        at = start[:, None] + np.arange(len(text)) + slip
        there |= (at >= 0) & (at < len(ids)) & (ids[np.clip(at, 0, len(ids) - 1)] == text)
    share = there @ weight / weight.sum()
    best = int(np.argmax(share))
    return float(share[best]), int(max(0, start[best]))


def _scan(library: Library, idf: np.ndarray, column: pa.Array) -> list[dict]:
    """Each text's words, base places and findings."""
    ids, first = library.numbered(column)
    has = library.present(ids, first)
    may = has.astype(np.float32) @ library.mandatory.T == library.mandatory.sum(axis=1)
    out = [{"n_words": int(n), "places": [], "findings": []} for n in np.diff(first)]
    for label, phrase in library.base:
        for d in np.flatnonzero(has[:, phrase].all(axis=1)):
            for p in _places(ids[first[d] : first[d + 1]], phrase, idf).tolist():
                out[d]["places"].append({"label": label, "word": p})
    for d in np.flatnonzero(may.any(axis=1)):
        own = ids[first[d] : first[d + 1]]
        stands: dict[bytes, np.ndarray] = {}
        for label, text, keys in (library.templates[t] for t in np.flatnonzero(may[d])):
            for _, key in keys:
                if key.tobytes() not in stands:
                    stands[key.tobytes()] = _places(own, key, idf)
            places = [stands[key.tobytes()] for _, key in keys]
            best = _fits(own, text, keys, places, idf) if all(map(len, places)) else None
            if best and best[0] >= SHARE:
                out[d]["findings"].append({"label": label, "word": best[1], "n_words": len(text), "share": best[0]})
    return out


def rarity(docs: DataFrame, library: Library, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency of each of the library's words over all ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count = 0, np.zeros(len(library.words), np.int64)
        for b in batches:
            for lo, hi in words.slices(b.column(0), words.BLOCK):
                count += library.present(*library.numbered(b.column(0).slice(lo, hi - lo))).sum(axis=0)
                n += hi - lo
        full = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.append(-1, full)), pa.array(np.append(n, count[full]))], names=["word", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n, seen = 0, np.zeros(len(library.words))
    for r in got.collect():  # a row for each word of the templates
        if r.word < 0:
            n = r.n
        else:
            seen[r.word] = r.n
    return np.log((n + 2) / (seen + 1))


_FOUND = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("findings", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])))])
_FOUND_SQL = "struct<n_words: bigint, places: array<struct<label: string, word: bigint>>, findings: array<struct<label: string, word: bigint, n_words: bigint, share: double>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, base: tuple = BASE) -> DataFrame:
    """``doc_id, n_words, places`` (of base phrases) ``, findings`` (of templates: label, first word, words, share)."""
    library = Library(templates, base)
    shared = docs.sparkSession.sparkContext.broadcast((library, rarity(docs, library, text_col)))

    @F.arrow_udf(_FOUND_SQL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, idf = shared.value
        for text in batches:
            parts = [_scan(known, idf, text.slice(lo, hi - lo)) for lo, hi in words.slices(text, words.BLOCK)]
            yield pa.array([x for part in parts for x in part], _FOUND)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("found"))
    return found.select("doc_id", "found.n_words", "found.places", "found.findings")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score of each document."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    at, base, own = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"]), F.transform("findings", lambda f: f["label"])
    share = F.coalesce(F.array_max(F.transform("findings", lambda f: f["share"])), F.lit(0.0))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.least(share, F.lit(1.0)))
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"))
