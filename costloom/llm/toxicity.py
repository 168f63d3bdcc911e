"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed into 2^BITS coordinates. Each coordinate
has its own rate, and the L1 term keeps coordinates at exactly zero until their evidence outweighs it, so the weights that are
left are few and are broadcast. Training reads a bounded sample; scoring reads every whole text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm import wordhash
from costloom.session import bound_batches

BITS = 20
# Training sample: rows per label, chosen by a hash of their ids, and passes over them.
SAMPLE = 2000
PASSES = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0


def features(text: bytes, ids: wordhash.PlainIds) -> np.ndarray:
    """Sorted distinct coordinates of a text. Words are lower-cased (A-Z) and lose punctuation at their ends."""
    one = ids.of(text.split())
    parts = [wordhash.mix(one)]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(one) > gap:
            parts.append(wordhash.mix(one[:-gap] * np.uint64(0x9E3779B97F4A7C15) + one[gap:] + np.uint64(salt)))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal updates; weights follow from z and n."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One update; the last coordinate is the bias."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def train(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> dict[int, float]:
    """Non-zero weights by coordinate, the bias under 2^BITS. Rows are visited in the given order, every pass."""
    model = Ftrl(2**BITS)
    for _ in range(passes):
        for at, label in rows:
            model.learn(at, label)
    w = model.weights(slice(None))
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """Weights from at most `sample` labelled documents of each label; the caller leaves out what is held out.

    The rows of the sample meet in one task, in an order given by a hash of their ids: at most 2 * sample feature lists. An id with
    several labels counts as toxic if one of them is. Without labels the weights are empty.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionAll(known.where("toxic = 0").orderBy(*order).limit(sample))
    # At most 2 * sample rows of two numbers.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wordhash.PlainIds()
        for b in batches:
            rows = [features(t or b"", ids) for t in wordhash.as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "doc_id"])
        w = train(list(zip(group["at"], group["toxic"], strict=True)))
        return pd.DataFrame({"i": list(w), "w": list(w.values())}).astype({"i": "int32", "w": "float64"})

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id long, toxic int, at array<int>").dropDuplicates(["doc_id"])
    found = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "i int, w double")
    # L1 leaves far fewer than 2^BITS weights, which bounds them in any case.
    return {r["i"]: r["w"] for r in found.collect()}


def score(spark: SparkSession, text: Column, weights: dict[int, float]) -> Column:
    """Probability that a whole text is toxic; null and empty texts get that of the bias alone."""
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.zeros(2**BITS + 1)
        w[list(shared.value)] = list(shared.value.values())
        ids = wordhash.PlainIds()
        for texts in batches:
            sums = np.array([w[features(t or b"", ids)].sum() for t in wordhash.as_bytes(texts)]) + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())

    return arrow_udf(run, "double")(text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (1 from 0.5 on).

    Labels of held-out ids are never read into the model, nor is any column but the text. Null and empty texts get the score of
    the bias. Repeated rows, null ids and very long texts pass as they are; other columns are ignored; an empty table gives no rows.
    """
    spark = bound_batches(docs.sparkSession)
    weights = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(spark, F.col(text_col).cast("string"), weights).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
