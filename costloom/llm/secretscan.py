"""Secrets in whole texts: fixed base patterns, and a guess-cost search over values in credential contexts.

The cost of a value is the least over all ways to cut it into words, dates, repeats, keyboard walks, sequences and
brute-force spans, found by dynamic programming in powers of ten: what people type is cheap, what a generator
prints is not. A value whose context names a credential and whose cost is high becomes a span of kind `guess`.
"""

import hashlib
import math
import operator
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm import lexicon
from costloom.llm.wordhash import as_bytes, released
from costloom.session import bound_batches

# Base patterns, kind -> (pattern, group that is measured, least length).
BASE = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(rb"[0-9a-f]+"), 0, 24),
}
# Every run of 24 hex characters lies in a run that counts; shorter runs need not be visited one by one.
_HEX_RUN = re.compile(rb"[0-9a-f]{24,}")
KINDS = [*BASE, "guess"]
CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private|signing)[_-]?key)"""
    rb"""(?P<mark>["']?\x20*[:=]+>?\x20*["']?|["']\x20+(?:is\x20+)?["']?|\x20+(?:is\x20+)?["'])?(?(mark)|\x20+(?:is\x20+)?)(?P<value>[^\s"',;<>()\[\]{}]{8,})""",
    re.I,
)
# A value is a secret from this cost on (power of ten of guesses).
LEAST_COST = 9.0
# Frequent words of chosen passwords, commonest first.
WORDS = (
    "password pass admin welcome login user root test guest secret token master letmein dragon monkey shadow sunshine "
    "princess football baseball superman batman hello love money summer winter spring autumn change default example "
    "sample demo temp changeme your this that please none null true false value string server client database public "
    "private access system service account secure hunter flower orange purple silver golden happy lucky magic star "
    "tiger eagle soccer hockey ginger pepper cookie cheese coffee computer internet google apple samsung freedom"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LONGEST_WORD = lexicon.LONGEST
# Signs that stand for letters in chosen passwords.
SIGNS = str.maketrans("4@310!$57", "aaeioisst")

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,8}?)\1+")


def _neighbours(a: str, b: str) -> bool:
    """Keys side by side, or the next or previous letter or digit."""
    if a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return True
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _spans(value: str, rank_of: dict[str, int] = _RANK) -> dict[int, list[tuple[int, float]]]:
    """end -> [(start, cost)] of every recognised span."""
    low, out = value.lower(), {}
    if len(low) != len(value):  # a letter whose lower case is longer
        low = value
    n = len(low)
    plain = low.translate(SIGNS)

    def add(i: int, j: int, cost: float) -> None:
        out.setdefault(j, []).append((i, cost))

    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            part, extra = low[i:j], 0.0 if value[i:j].islower() else 0.6
            if (rank := rank_of.get(part)) is not None:
                add(i, j, math.log10(rank) + extra)
            if (rank := rank_of.get(part[::-1])) is not None:
                add(i, j, math.log10(rank) + math.log10(2) + extra)
            if (meant := plain[i:j]) != part and (rank := rank_of.get(meant)) is not None:
                add(i, j, math.log10(rank) + math.log10(2) * (1 + sum(map(operator.ne, meant, part))) + extra)
        if m := _DATE.match(low, i):
            add(i, m.end(), 2.0 if m.end() - i == 4 else math.log10(365 * 120))
    for m in _REPEAT.finditer(low):
        block, times = m[1], (m.end() - m.start()) // len(m[1])
        if len(block) > 1 or times > 2:
            add(m.start(), m.end(), sum(map(_brute, block)) + math.log10(times))
    start = 0
    for i in range(1, n + 1):
        if i == n or not _neighbours(low[i - 1], low[i]):
            if i - start >= 3:
                add(start, i, math.log10(47) + 0.4 * (i - start))
            start = i
    return out


def guess_cost(value: str, rank_of: dict[str, int] = _RANK) -> float:
    """Power of ten of the guesses for the cheapest segmentation; each further segment doubles them. Linear in the length:
    spans are words of bounded length (as they are, reversed, or with signs for letters), dates, and maximal repeats and
    walks."""
    known = _spans(value, rank_of)
    step = math.log10(2)
    best = [0.0] * (len(value) + 1)
    brute = [False] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        # Brute force goes on from a brute-force character without a new segment.
        best[j] = best[j - 1] + _brute(value[j - 1]) + (0 if brute[j - 1] else step)
        brute[j] = True
        for i, cost in known.get(j, ()):
            if best[i] + cost + step < best[j]:
                best[j], brute[j] = best[i] + cost + step, False
    return best[-1]


def is_guess(value: str, marked: bool = False, rank_of: dict[str, int] = _RANK) -> bool:
    """Costly to guess. Where no sign or quote parts the value from its keyword (`marked`), prose may go on, with words that no
    list holds: there it needs a letter and a digit too."""
    varied = marked or any(map(str.isdigit, value)) and any(map(str.isalpha, value))
    return varied and guess_cost(value, rank_of) >= LEAST_COST


def find(text: bytes, rank_of: dict[str, int] = _RANK) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, spans added by guess cost) as (start, kind, end) byte positions."""
    base = []
    for kind, (pattern, group, least) in BASE.items():
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                base.append((m.start(), kind, m.end()))
    # Base spans by their starts, with the furthest end so far: a value overlaps one if one that starts before its end reaches
    # beyond its start.
    starts, reach = [], []
    for x, _, y in sorted(base):
        starts.append(x)
        reach.append(max(y, reach[-1] if reach else 0))
    added = []
    for m in CONTEXT.finditer(text):
        a, b = m.span("value")
        before = bisect_left(starts, b)
        if not (before and reach[before - 1] > a) and is_guess(m["value"].decode("utf-8", "replace"), m["mark"] is not None, rank_of):
            added.append((a, "guess", b))
    return base, added


def _order(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def _joined(text: bytes, spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end in code points."""
    if not spans:
        return ""
    cuts = sorted({p for a, _, b in spans for p in (a, b)})
    if text.isascii():
        at = cuts
    else:
        at, done, chars = [], 0, 0
        for c in cuts:
            chars += len(text[done:c].decode("utf-8"))
            done = c
            at.append(chars)
    place = lambda p: at[bisect_left(cuts, p)]
    return ",".join(f"{k}:{place(a)}:{place(b)}" for a, k, b in sorted(spans, key=_order))


def fit_lexicon(docs: DataFrame, vocabularies: list[str], text_col: str = "text") -> dict[str, int]:
    """Ranks of WORDS, then of the words of vocabulary files and of the corpus: one pass over all documents, and at most some
    ten thousands of words from each."""
    return lexicon.ranks(WORDS, *map(lexicon.vocabulary_words, vocabularies), lexicon.corpus_words(docs, text_col))


def _shared(spark: SparkSession, rank_of: dict[str, int] | None):  # noqa: ANN202
    return spark.sparkContext.broadcast(_RANK if rank_of is None else rank_of)


def scan(spark: SparkSession, text: Column, rank_of: dict[str, int] | None = None) -> Column:
    """struct(n_assign, n_access, n_hex, n_guess, base_sha256, spans) of each whole text; null is empty."""
    fields = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())]
    words = _shared(spark, rank_of)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in as_bytes(texts):
                base, added = find(text or b"", words.value)
                counts = [sum(k == kind for _, k, _ in base + added) for kind in KINDS]
                digest = hashlib.sha256(_joined(text or b"", base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(text or b"", base + added)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    kinds = ",".join(f"n_{k}:bigint" for k in KINDS)
    return arrow_udf(released(run), f"struct<{kinds},base_sha256:string,spans:string>")(text)


def mask(text: bytes, rank_of: dict[str, int] = _RANK) -> bytes:
    """The text with every span, overlapping ones together, replaced by [redacted:kind]."""
    base, added = find(text, rank_of)
    out, done = [], 0
    for a, kind, b in sorted(base + added, key=_order):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[redacted:{kind}]".encode()]
        done = b
    return b"".join([*out, text[done:]])


def redact(spark: SparkSession, text: Column, rank_of: dict[str, int] | None = None) -> Column:
    """The text without its secrets; null stays null."""
    words = _shared(spark, rank_of)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else mask(t, words.value).decode("utf-8") for t in as_bytes(texts)], pa.string())

    return arrow_udf(released(run), "string")(text)


def scan_documents(docs: DataFrame, vocabularies: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, counts per kind, base_sha256, spans.

    With `vocabularies` (files of public tokenizers, possibly none) costs rest on `fit_lexicon`, else on WORDS alone.

    Null and empty texts have no spans; null ids, repeated rows and very long texts pass as they are; other columns
    are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rank_of = None if vocabularies is None else fit_lexicon(docs, vocabularies, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), scan(docs.sparkSession, F.col(text_col).cast("string"), rank_of).alias("s")).select("doc_id", "s.*")


def redact_documents(docs: DataFrame, vocabularies: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text redacted and n_chars, if there is one, measured again."""
    bound_batches(docs.sparkSession)
    rank_of = None if vocabularies is None else fit_lexicon(docs, vocabularies, text_col)
    out = docs.withColumn(text_col, redact(docs.sparkSession, F.col(text_col).cast("string"), rank_of))
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
