"""License scans: winnowed fingerprints of templates, an inverted index, and banded alignment of the candidates.

Long templates (whole licenses) have an index of their own with longer grams, which prose does not hit by chance. Of reports
on one place the one with most matching words stays, so a text is not named as its license's near relatives too.

Words are compared in lower case without punctuation at their ends. Of every `WINDOW` neighbouring `GRAM`-word digests the least is
kept, on both sides, so a template and a text that share WINDOW + GRAM - 1 words in a row share a fingerprint. Fingerprint
hits of one template on nearby diagonals make a candidate; it is aligned with the text around that diagonal,
inside a band, and reported with the share of the template's words that match and the span they cover.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm import wordhash
from costloom.session import bound_batches

GRAM = 2
WINDOW = 2
BAND, WIDEST = 6, 40
LEAST_COVERAGE = 0.75
# Share of a template's fingerprints that must be hit on nearby diagonals; one is enough for short templates.
LEAST_HITS = 0.1
# Templates of more words: grams and window of their index.
LONG_WORDS, LONG_GRAM, LONG_WINDOW = 400, 5, 8
# A report that shares so much of its span with a better one is the same place.
SAME_PLACE = 0.8
# The templates and their index go to every task.
MAX_TEMPLATE_BYTES = 16_000_000
_WORD = re.compile(rb"[^ \t-\r]+")


class Words(wordhash.PlainIds):
    """Digests of words without punctuation and comment marks at their ends. A word of nothing else (`#`, `*`, `//`, `--`, `;`)
    and a comment word is NOTHING and no part of a text's sequence."""

    # Words that open a comment line.
    COMMENT_WORDS = (b"rem", b"dnl")

    ENDS = wordhash.PlainIds.ENDS + b"/-_=|~+%\\"
    NOTHING = np.uint64(xxhash.xxh3_64_intdigest(b""))

    def __missing__(self, word: bytes) -> int:
        if word.lower().strip(self.ENDS) in self.COMMENT_WORDS:
            self[word] = int(self.NOTHING)
            return int(self.NOTHING)
        return super().__missing__(word)

    def sequence(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(digests, positions) of the words that count."""
        all_of = self.of(words)
        at = np.flatnonzero(all_of != self.NOTHING)
        return all_of[at], at


# License statements and notices, id -> texts; those of the files come on top.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the %Apache License, Version %2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC %BY-NC %4.0.", "This work is licensed under a Creative Commons %Attribution-NonCommercial %4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU %General Public License, version %3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the %MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Proprietary": ["All rights reserved."],
}


def load_templates(folder: Path = Path(__file__).parent / "license_texts") -> dict[str, list[str]]:
    """TEMPLATES, the notices of notices.tsv and the whole texts of ID.txt (or ID@N.txt for a further variant)."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for line in (folder / "notices.tsv").read_text("utf-8").splitlines():
        if line and not line.startswith("#"):
            name, text = line.split("\t")
            out.setdefault(name, []).append(text)
    for path in sorted(folder.glob("*.txt")):
        out.setdefault(path.stem.partition("@")[0], []).append(path.read_text("utf-8"))
    return out


def winnow(ids: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(digests, positions) of the kept grams; texts shorter than a gram are one gram."""
    grams = wordhash.shingles(ids, gram)
    if len(grams) <= window:
        return grams, np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    return grams[at], at


@dataclass
class Index:
    """Inverted index of templates: sorted digests, each with the templates and positions it comes from."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    template: np.ndarray
    position: np.ndarray
    must: list[np.ndarray]
    gram: int = GRAM
    window: int = WINDOW
    long: "Index | None" = None

    @classmethod
    def build(cls, templates: dict[str, list[str]]) -> "Index":
        """The index of the short templates, with that of the long ones in `long`."""
        size = lambda t: len(t.split()) > LONG_WORDS
        short, long = ({n: [t for t in ts if size(t) == big] for n, ts in templates.items()} for big in (False, True))
        out = cls._of(short, GRAM, WINDOW)
        if any(long.values()):
            out.long = cls._of(long, LONG_GRAM, LONG_WINDOW)
        return out

    @classmethod
    def _of(cls, templates: dict[str, list[str]], gram: int, window: int) -> "Index":
        if sum(len(t.encode()) for ts in templates.values() for t in ts) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} bytes")
        ids = Words()
        names, words, rows, must = [], [], [], []
        for name, texts in templates.items():
            for text in texts:
                cut = text.encode().split()
                w, at = ids.sequence([c.removeprefix(b"%") for c in cut])
                if len(w):
                    rows += [(int(d), len(names), int(p)) for d, p in zip(*winnow(w, gram, window), strict=True)]
                    must.append(w[[cut[i].startswith(b"%") for i in at]])
                    names.append(name)
                    words.append(w)
        rows.sort()
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return cls(names, words, np.array(cols[0], np.uint64), np.array(cols[1], np.int64), np.array(cols[2], np.int64), must, gram, window)

    def band(self, template: int) -> int:
        """Words of drift: an eighth of a short template, for marks that are words (`REM`, `dnl`) or line numbers."""
        n = len(self.words[template])
        return max(BAND, min(n // 8, WIDEST), n // 100)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal): places where the template may start. Hits whose diagonals lie within a band are one
        place, and a place needs at least LEAST_HITS of the template's fingerprints: words that all prose shares make
        single hits everywhere."""
        digests, at = winnow(ids, self.gram, self.window)
        lo = np.searchsorted(self.keys, digests, "left")
        counts = np.searchsorted(self.keys, digests, "right") - lo
        some = np.flatnonzero(counts)
        if not len(some):
            return []
        counts = counts[some]
        row = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        template = self.template[row]
        diagonal = np.repeat(at[some], counts) - self.position[row]
        need = np.maximum(1, (LEAST_HITS * np.bincount(self.template, minlength=len(self.names))).astype(int))
        enough = np.bincount(template, minlength=len(need))[template] >= need[template]
        order = np.lexsort((diagonal[enough], template[enough]))
        out: list[tuple[int, int]] = []
        held: list[int] = []
        for t, d in zip(template[enough][order].tolist(), diagonal[enough][order].tolist(), strict=True):
            if not out or out[-1][0] != t or d - out[-1][1] > self.band(t):
                out.append((t, d))
                held.append(0)
            held[-1] += 1
        return [place for place, n in zip(out, held, strict=True) if n >= need[place[0]]]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matches, first, last + 1): the alignment with most matching words, then the latest start, then the earliest end.

    Cell (i, o) stands for template word i and text word i + diagonal + o - band, with o inside the band. Words may be skipped on
    either side. A cell is one number: matches, first and negated last matched place in falling weight, so that a row is
    the larger of the cells above and across, carried along the text by a running maximum.
    """
    width, low = 2 * band + 1, diagonal - band
    at = np.arange(low, low + len(template) + width)
    inside = (at >= 0) & (at < len(text))
    near = text[np.clip(at, 0, len(text) - 1)]
    row = np.zeros(width + 1, np.int64)  # one more: nothing lies beyond the band
    place = np.arange(width, dtype=np.int64)
    for i, word in enumerate(template):
        r = place + i
        hit = np.where(row[:-1] > 0, (row[:-1] & ~_LAST) + _ONE, _ONE | r << 20) | (_LAST - r)
        across = np.where((near[i : i + width] == word) & inside[i : i + width], hit, row[:-1])
        row[:-1] = np.maximum.accumulate(np.maximum(across, row[1:]))
    best = int(row.max())
    return (best >> 40, (best >> 20 & _LAST) + low, _LAST - (best & _LAST) + low + 1) if best else (0, 0, 0)


_ONE, _LAST = 1 << 40, (1 << 20) - 1


def matches(text: bytes, index: Index, ids: Words, least: float = LEAST_COVERAGE) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) in code points, by place; of overlapping reports of one license the best stays."""
    words, own = ids.sequence(text.split())
    if not len(words):
        return []
    best: list[tuple[str, int, int, float, int]] = []
    for part in (index, index.long):
        # A report needs `least` of a template, so texts shorter than that of every template have none.
        for t, d in part.candidates(words) if part and len(words) >= least * min(map(len, part.words), default=0) else ():
            template, band = part.words[t], part.band(t)
            # Where too few of the template's words occur at all, or a needed one does not, no alignment can be reported.
            near = words[max(0, d - band) : max(0, d + len(template) + band)]
            if np.isin(template, near).sum() < least * len(template) or not np.isin(part.must[t], near).all():
                continue
            m, first, end = align(template, words, d, band)
            # The span must not be much longer than the template: matched words far apart are chance.
            if m and m / len(template) >= least and end - first <= len(template) + max(band, len(template) // 8) and np.isin(part.must[t], words[first:end]).all():
                best.append((part.names[t], first, end, m / len(template), m))
    kept: list[tuple[str, int, int, float]] = []
    for b in sorted(best, key=lambda b: (-b[4], -b[3], b[1], b[0])):
        shared = lambda k: min(k[2], b[2]) - max(k[1], b[1])  # noqa: E731, B023
        if not any(shared(k) > 0 and (k[0] == b[0] or shared(k) >= SAME_PLACE * (b[2] - b[1])) for k in kept):
            kept.append(b[:4])
    if not kept:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    chars = (lambda p: p) if text.isascii() else (lambda p: len(text[:p].decode("utf-8")))
    return sorted(((n, chars(places[own[a]][0]), chars(places[own[b - 1]][1]), c) for n, a, b, c in kept), key=lambda r: (r[1], r[2], r[0]))


def scan(text: Column, templates: dict[str, list[str]] | None = None) -> Column:
    """array<struct(license, start, end, coverage)> of a whole text."""
    index = Index.build(load_templates() if templates is None else templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = Words()
        for texts in batches:
            rows = [matches(t or b"", index, ids) for t in wordhash.as_bytes(texts)]
            yield pa.array([[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, c in r] for r in rows], kind)

    return arrow_udf(run, "array<struct<license:string,start:bigint,end:bigint,coverage:double>>")(text)


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_matches, licenses (distinct, sorted, comma-joined), matches.

    Null and empty texts have no matches. Nulls and repeats of ids, very long texts and extra columns are harmless; an empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col).cast("string"), templates).alias("matches"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        "matches",
    )
