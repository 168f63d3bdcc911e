"""Ranked lexical search over all documents by the Best Position Algorithm.

Every document is cut into terms once; counts of the queries' terms go into a forward index beside the document's length, and
the corpus' statistics are aggregates of it. Shards of that index, bounded in postings, are searched where they lie: a
shard sorts each term's postings by impact and answers every query with its own best k, so postings are never shuffled
and a term that stands in every document is spread like any other. The shards' answers, k rows each, are merged.

In a shard the algorithm reads the lists of a query's terms from the top in parallel. A document that is met for the first
time is looked up in all lists, which gives its whole score and marks its place in each of them as seen. The best position
of a list is the end of its unbroken run of seen places, often far beyond what was read from it. No unseen document can score
more than the sum of the impacts just beyond the best positions; the search ends when that sum is strictly below the k-th score, so
that ties by document id are whole too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costloom.llm import wordhash
from costloom.session import stage

# Text of the queries that are broadcast at a time; more queries are more passes over the documents.
BLOCK_BYTES = 4_000_000
# Postings of a shard: some 80 MB in a task.
SHARD_POSTINGS = 1_500_000
# Places read from each list in the first round; doubled in every later one.
FIRST_READ = 16
# Byte -> byte: A-Z in lower case, 0-9, a-z and bytes of non-ASCII characters as they are, all else a blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence class of a term adds to a document's score, before the term's weight."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class ImpactList:
    """A term's postings in a shard: by impact for sorted access, by document for direct access."""

    def __init__(self, docs: np.ndarray, values: np.ndarray):
        self.by_doc, self.value_of = docs, values
        order = np.argsort(-values, kind="stable")
        self.docs, self.values = docs[order], values[order]

    def look_up(self, docs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.by_doc, docs), len(self.by_doc) - 1)
        return np.where(self.by_doc[at] == docs, self.value_of[at], 0)


def best_positions(lists: list[ImpactList], weights: list[int], order: np.ndarray, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, places read) of the k highest scores above 0; `order` ranks documents that tie.

    Lists with a weight of 0 must not be given.
    """
    seen = np.zeros(len(order), bool)
    best = [0] * len(lists)
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    step, read = first_read, 0
    while True:
        met = [lst.docs[b : b + step] for lst, b in zip(lists, best)]
        read += sum(map(len, met))
        fresh = np.unique(np.concatenate(met))
        fresh = fresh[~seen[fresh]]
        if len(fresh):
            seen[fresh] = True
            score = np.zeros(len(fresh), np.int64)
            for lst, w in zip(lists, weights):
                score += w * lst.look_up(fresh)
            docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, score])
            top = np.lexsort((order[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
        limit = 0
        for i, lst in enumerate(lists):
            # What was read is seen; the run may go on beyond it.
            at = min(best[i] + step, len(lst.docs))
            while at < len(lst.docs) and seen[lst.docs[at]]:
                run = seen[lst.docs[at : at + 256]]
                at += len(run) if run.all() else int(np.argmin(run))
            best[i] = at
            if at < len(lst.docs):
                limit += weights[i] * int(lst.values[at])
        if limit == 0 or (len(docs) == k and limit < scores[-1]):
            return docs[scores > 0], scores[scores > 0], read
        step *= 2


@dataclass
class Queries:
    """Queries of one block: names, and per query its terms' numbers with their repeats; numbers of all terms."""

    names: list[int]
    counts: list[list[tuple[int, int]]]
    numbers: dict[bytes, int]


def _queries(rows: list) -> Queries:
    numbers: dict[bytes, int] = {}
    counts = []
    for r in rows:
        terms = Counter(terms_of((r.text or "").encode()))
        counts.append([(numbers.setdefault(t, len(numbers)), c) for t, c in terms.items()])
    return Queries([r.q for r in rows], counts, numbers)


def _forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and its counts of the queries' terms."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, sizes, terms, tfs = [], [0], [], []
                for text in wordhash.as_bytes(part.column(1)):
                    words = terms_of(text)
                    found = Counter(map(number, words))
                    found.pop(None, 0)
                    n.append(len(words))
                    terms.extend(found.keys()), tfs.extend(found.values())
                    sizes.append(len(terms))
                cut = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (terms, tfs))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _answers(forward: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int, postings: int) -> DataFrame:
    """(q, doc_id, score): the best k documents of every shard for every query."""
    df = dict(map(tuple, forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
    weights = [weight(n_docs, df.get(t, 0)) for t in range(len(queries.numbers))]
    shared = forward.sparkSession.sparkContext.broadcast((queries.names, queries.counts, weights))

    def search(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, weights = shared.value
        table = pa.Table.from_batches(parts)
        ids = table["doc_id"].combine_chunks()
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table["terms"].chunks])
        term, tf = (np.concatenate([c.flatten().to_numpy() for c in table[x].chunks]) for x in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        value = impacts(tf.astype(np.int64), table["n"].to_numpy()[doc], n_docs, n_terms)
        by_term = np.argsort(term, kind="stable")
        term, doc, value = term[by_term], doc[by_term], value[by_term]
        at = np.searchsorted(term, np.arange(len(weights) + 1))
        lists: dict[int, ImpactList] = {}
        # Ties go to the smaller id, rows without one last.
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
        out: tuple[list, list, list] = ([], [], [])
        for name, terms in zip(names, counts):
            own = [(t, c * weights[t]) for t, c in terms if weights[t] > 0 and at[t] < at[t + 1]]
            if not own:
                continue
            for t, _ in own:
                if t not in lists:
                    lists[t] = ImpactList(doc[at[t] : at[t + 1]], value[at[t] : at[t + 1]])
            docs, scores, _ = best_positions([lists[t] for t, _ in own], [w for _, w in own], order, k)
            out[0].append(np.full(len(docs), name)), out[1].append(docs), out[2].append(scores)
        if out[0]:
            q, d, s = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids.take(pa.array(d)), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= postings:
                yield from search(held)
                held, size = [], 0
        if size:
            yield from search(held)

    return forward.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "q long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score.

    Terms are maximal runs of 0-9, letters and non-ASCII characters of the whole text, A-Z lower-cased; null and empty texts
    have none and are found by nothing, and items without terms find nothing. Equal scores go to the smaller id, rows without an
    id last. Repeated rows of documents are documents of their own, repeated rows of items are answered each. Empty tables on
    either side give no rows; extra columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = stage(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("q")), "ranked-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    found = None
    for b in range(blocks):
        queries = _queries(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect())
        forward = stage(_forward(narrow, queries), "ranked-forward")
        n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = _answers(forward, queries, n_docs, n_terms, k, shard_postings)
        found = own if found is None else found.unionAll(own)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", best).where(F.col("rank") <= k)
    return top.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
