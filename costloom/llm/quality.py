"""Quality rules: base counts of every whole text, and a linear-chain CRF that labels its lines.

The CRF gives each line a state, content or boilerplate, from binary features of the line and the state of the
line before. Its weights are learned from a bounded sample of labelled documents: as they are, the label standing for all
their lines, and spliced, with lines of a document of one label inside one of the other, so that training sees where the state
changes inside a text. Viterbi decoding labels every line of every text, and the share of words in content lines decides.
"""

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm import wordhash
from costloom.session import bound_batches

# Least share of words in content lines.
LEAST_SHARE = 0.5
# Training sample: documents per label, and lines per document, in stretches spread over the whole text.
SAMPLE = 600
SAMPLE_LINES, STRETCH = 256, 64
# Fixed values of the base rules.
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = SYMBOLS + b"!{}[]=~^_@\\/"
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_NOT_IN_WORD = np.isin(np.arange(256), list(_SPACE)) | ((np.arange(256) & 0xC0) == 0x80)
# Edges of the bins of each measure of a line.
EDGES = {
    "words": (2, 4, 8, 16),
    "marks": (0.005, 0.02, 0.06, 0.15),
    "upper": (0.08, 0.2, 0.4, 0.7),
    "same": (0.01, 0.1, 0.3, 0.6),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "length": (2.5, 4, 7, 12),
    "digits": (0.01, 0.1, 0.3, 0.6),
    "again": (0.5,),
    "ended": (0.5,),
}
N_FEATURES = sum(len(e) + 1 for e in EDGES.values())
_OFFSETS = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())][:-1])
_BINS = [np.array(e) for e in EDGES.values()]


def measures(text: bytes) -> tuple[np.ndarray, list[int]]:
    """(measures, words) of the lines that hold a word."""
    rows, counts, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        rows.append(
            (
                n,
                (size - len(line.translate(None, _MARKS))) / size,
                (size - len(line.translate(None, _UPPER))) / size,
                sum(map(operator.eq, words, words[1:])) / n,
                len(set(words)) / n,
                sum(map(len, words)) / n,
                (size - len(line.translate(None, _DIGITS))) / size,
                line in seen,
                words[-1][-1:] in b".!?:;\"'",
            )
        )
        seen.add(line)
        counts.append(n)
    return np.array(rows, np.float64).reshape(-1, len(EDGES)), counts


def features(rows: np.ndarray) -> np.ndarray:
    """Index of the one active feature per measure and line."""
    cols = [np.digitize(rows[:, i], edges) + _OFFSETS[i] for i, edges in enumerate(_BINS)]
    return np.stack(cols, axis=1).astype(np.int32) if len(rows) else np.empty((0, len(_BINS)), np.int32)


class Chain:
    """Weights of a two-state linear-chain CRF: state scores per feature, transitions and start."""

    def __init__(self, state: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.state, self.move, self.start = state, move, start

    def viterbi(self, active: np.ndarray) -> np.ndarray:
        """Most probable states of the lines, 1 for content."""
        score = self.state[active].sum(axis=1)
        (a, b), ((m00, m01), (m10, m11)) = (self.start + score[0]).tolist(), self.move.tolist()
        back = []
        for s0, s1 in score[1:].tolist():
            p0, p1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((p0, p1))
            a, b = (b + m10 if p0 else a + m00) + s0, (b + m11 if p1 else a + m01) + s1
        out = [int(b >= a)]
        for pair in reversed(back):
            out.append(int(pair[out[-1]]))
        return np.array(out[::-1])


def stretches(lines: np.ndarray) -> list[np.ndarray]:
    """All lines of a text in stretches of at most STRETCH, or SAMPLE_LINES of them in stretches evenly spread over it."""
    n = len(lines)
    if n <= SAMPLE_LINES:
        return [lines[i : i + STRETCH] for i in range(0, n, STRETCH)]
    starts = np.linspace(0, n - STRETCH, SAMPLE_LINES // STRETCH).astype(int)
    return [lines[i : i + STRETCH] for i in starts]


def splice(content: list[np.ndarray], other: list[np.ndarray], seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(sequences, line labels): stretches of both kinds in pairs, a run of lines of one put inside, before or after the other."""
    rng = np.random.default_rng(seed)
    sequences, labels = [], []
    for i in range(max(len(content), len(other)) if content and other else 0):
        pair = [(content[i % len(content)], 1), (other[i % len(other)], 0)]
        for (outer, a), (inner, b) in (pair, pair[::-1]):
            at, n = int(rng.integers(len(outer) + 1)), int(rng.integers(1, len(inner) + 1))
            first = int(rng.integers(len(inner) - n + 1))
            sequences.append(np.concatenate([outer[:at], inner[first : first + n], outer[at:]]))
            labels.append(np.repeat([a, b, a], [at, n, len(outer) - at]))
    return sequences, labels


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class _Padded:
    """Sequences of about one length, padded to the longest; gradients of their log-likelihood."""

    def __init__(self, sequences: list[np.ndarray], labels: list[np.ndarray]):
        n, self.longest = len(sequences), max(map(len, sequences))
        self.active = np.zeros((n, self.longest, len(_BINS)), np.int32)
        self.there = np.zeros((n, self.longest), bool)
        for k, s in enumerate(sequences):
            self.active[k, : len(s)], self.there[k, : len(s)] = s, True
        self.lines = int(self.there.sum())
        self.flat = self.active[self.there]
        self.y = np.eye(2)[np.concatenate(labels)]
        self.starts = np.bincount([a[0] for a in labels], minlength=2)
        self.moves = np.bincount(np.concatenate([2 * a[:-1] + a[1:] for a in labels]), minlength=4).reshape(2, 2)

    def gradient(self, w: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward and backward sums over positions, for all sequences together."""
        score = w[self.active].sum(axis=2)
        fore, back = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = start + score[:, 0]
        for t in range(1, self.longest):
            on = _soft(fore[:, t - 1, :, None] + move, 1) + score[:, t]
            fore[:, t] = np.where(self.there[:, t, None], on, fore[:, t - 1])
        for t in range(self.longest - 2, -1, -1):
            on = _soft(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(self.there[:, t + 1, None], on, 0)
        z = _soft(fore[:, -1], 1)
        p = np.exp(fore + back - z[:, None, None])[self.there]
        pair = fore[:, :-1, :, None] + move + (score[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0))[self.there[:, 1:]]
        diff = np.repeat(self.y - p, self.flat.shape[1], axis=0)
        g_w = np.stack([np.bincount(self.flat.ravel(), weights=diff[:, k], minlength=N_FEATURES) for k in range(2)], axis=1)
        return g_w, self.moves - pair.sum(axis=0), self.starts - np.exp(fore[:, 0] + back[:, 0] - z[:, None]).sum(axis=0)


def train(sequences: list[np.ndarray], labels: list[int | np.ndarray], steps: int = 120, l2: float = 1.0) -> Chain:
    """Maximum-likelihood weights with an L2 prior, by gradient steps on all sequences at once. A sequence's label is one for
    all its lines, or one for each. Sequences of like lengths are padded and summed together."""
    line = [np.broadcast_to(np.asarray(a), len(s)) for a, s in zip(labels, sequences, strict=True)]
    groups: list[list[int]] = []
    for k in sorted(range(len(sequences)), key=lambda k: len(sequences[k])):
        if not groups or len(sequences[k]) > 1.3 * len(sequences[groups[-1][0]]) + 1:
            groups.append([])
        groups[-1].append(k)
    parts = [_Padded([sequences[k] for k in g], [line[k] for k in g]) for g in groups]
    total = sum(p.lines for p in parts)
    params = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    sums, moments = [0.0] * 3, [0.0] * 3
    for step in range(1, steps + 1):
        found = [p.gradient(*params) for p in parts]
        for k in range(3):
            g = (sum(f[k] for f in found) - l2 * params[k]) / total
            sums[k] = 0.9 * sums[k] + 0.1 * g
            moments[k] = 0.99 * moments[k] + 0.01 * g * g
            params[k] += 0.1 * (sums[k] / (1 - 0.9**step)) / (np.sqrt(moments[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(*params)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """The CRF from at most `sample` labelled documents of each quality, chosen by a hash of their ids, and
    SAMPLE_LINES lines of each at most, spread over the whole text. None where labels show one quality only: then the base rules decide alone."""
    bound_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(sample).unionAll(known.where("quality = 1").orderBy(*order).limit(sample))
    # At most 2 * sample rows of two numbers.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [features(measures(t or b"")[0]) for t in wordhash.as_bytes(batch.column(1))]
            rows = [np.concatenate(stretches(x)).ravel() if len(x) else x.ravel() for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "quality", "active"])

    found = texts.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, active array<int>")
    one = found.where("size(active) > 0").groupBy("doc_id").agg(F.min(F.struct("quality", "active")).alias("r")).select("doc_id", "r.*")
    parts: tuple[list, list] = ([], [])
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        lines = np.array(r["active"], np.int32).reshape(-1, len(_BINS))
        parts[r["quality"]].extend(lines[i : i + STRETCH] for i in range(0, len(lines), STRETCH))
    return train(*sample_of(*parts)) if all(parts) else None


def sample_of(other: list[np.ndarray], content: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Training sequences and line labels of stretches: as they are, and spliced."""
    sequences, labels = splice(content, other)
    for kind, own in ((0, other), (1, content)):
        sequences += own
        labels += [np.full(len(s), kind) for s in own]
    return sequences, labels


def base_counts(text: bytes, ids: wordhash.WordIds) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int(_NOT_IN_WORD[raw].sum())
    symbols = int(_IS_SYMBOL[raw].sum())
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        _, at, counts = np.unique(wordhash.shingles(ids.of(words), WINDOW), return_inverse=True, return_counts=True)
        twice = (counts[at] > 1).astype(np.int64)
        if twice.any():
            edge = np.zeros(len(words) + 1, np.int64)
            edge[: len(twice)] += twice
            edge[WINDOW : WINDOW + len(twice)] -= twice
            repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), chars, symbols, again, repeated


def judge(text: Column, chain: Chain | None, least_share: float = LEAST_SHARE) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = wordhash.WordIds()
        for texts in batches:
            rows = []
            for text in wordhash.as_bytes(texts):
                text = text or b""
                counts = base_counts(text, ids)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
                share = 1.0
                if chain is not None and counts[0]:
                    lines, words = measures(text)
                    share = float((chain.viterbi(features(lines)) * words).sum() / counts[0])
                rows.append((*counts, failed, share, not failed and share >= least_share))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*names, "base_failed", "content_share", "kept"])

    ddl = ",".join(f"{n}:bigint" for n in names)
    return arrow_udf(wordhash.released(run), f"struct<{ddl},base_failed:boolean,content_share:double,kept:boolean>")(text)


def judge_documents(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, the base counts, base_failed, content_share, kept.

    Null and empty texts have no words and fail. Null ids, repeated rows and very long texts pass as they are; extra
    columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col).cast("string"), chain).alias("q")).select("doc_id", "q.*")


def keep_documents(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    bound_batches(docs.sparkSession)
    verdict = judge(F.col(text_col).cast("string"), chain).getField("kept")
    name = "_quality_kept"
    return docs.withColumn(name, verdict).where(F.col(name)).drop(name)
