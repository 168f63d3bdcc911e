"""Keyword, vector and hybrid retrieval as scans with top-k; no index structures.

A search is one query string (and one vector) over a whole table: statistics are a single aggregate, scores
are row expressions, and the result is a TakeOrderedAndProject, so no text is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costloom.functions.text import col, is_blank
from costloom.operators.listing import Cursor, after_cursor, page

# Leg sizes, fusion constant, answer sizes, ranking constants of BM25.
KEYWORD_LEG = 200
VECTOR_LEG = 50
RRF_K = 60
ASK_RUNS = 6
ASK_CHUNKS = 4
BM25_K1 = 1.2
BM25_B = 0.75
EMBED_DIMS = 384
EMBED_CHARS = 4000

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def query_terms(q: str) -> list[str]:
    """Distinct terms of a query string, in order of appearance."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


# ---------------------------------------------------------------- run documents and filters


def searchable_text() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("workspace", "persona", "external_id", "session_id")]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(" "), p)
    return out


def run_documents(runs: DataFrame) -> DataFrame:
    """Runs as search documents: four fields joined by single spaces, nulls as empty slots."""
    return runs.withColumn("searchable_text", searchable_text())


@dataclass(frozen=True)
class Filters:
    model: str | None = None
    persona: str | None = None
    source: str | None = None
    status: str | None = None
    start: str | None = None
    end: str | None = None


def search_filters(docs: DataFrame, f: Filters | None) -> DataFrame:
    """Exact-value and closed time filters, as predicates that reach the scan."""
    if f is None:
        return docs
    for column, value in (("model_slug", f.model), ("persona", f.persona), ("source", f.source), ("status", f.status)):
        if value is not None:
            docs = docs.where(F.col(column) == value)
    if f.start is not None:
        docs = docs.where(F.col("started_at") >= F.lit(f.start).cast("timestamp"))
    if f.end is not None:
        docs = docs.where(F.col("started_at") <= F.lit(f.end).cast("timestamp"))
    return docs


# ---------------------------------------------------------------- keyword search


def matching(docs: DataFrame, q: str, text: str = "searchable_text") -> DataFrame:
    """Documents holding any query term as a token. A cheap substring test runs before tokenizing."""
    terms = query_terms(q)
    if not terms:
        return docs.where(F.lit(False))
    low = F.lower(F.col(text))
    near = F.lit(False)
    for t in terms:
        near = near | low.contains(t)
    return docs.where(near).where(F.arrays_overlap(tokens(text), F.array(*[F.lit(t) for t in terms])))


def search_keyword(
    docs: DataFrame,
    q: str,
    limit: int = 30,
    cursor: Cursor | None = None,
    filters: Filters | None = None,
    text: str = "searchable_text",
) -> DataFrame:
    """Any-term search in (started_at desc nulls last, id desc) order, limit + 1 rows.

    `total` counts all matches, not the page, so it is the same on every page.
    """
    hits = matching(search_filters(docs, filters), q, text)
    total = hits.agg(F.count(F.lit(1))).scalar()
    return page(after_cursor(hits, cursor), limit).withColumn("total", total)


def highlight(text: Column | str, q: str, size: int = 150, fragments: int = 2) -> Column:
    """The first fragments that hold a query term, with the terms wrapped in <em>.

    A fragment has `size` characters and goes on to the end of the word it would cut, so every word lies whole in
    exactly one fragment.
    """
    terms = F.array(*[F.lit(t) for t in query_terms(q)])
    c = col(text)
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{size}}}[\p{{L}}\p{{N}}]*"), F.lit(0))
    hits = F.filter(pieces, lambda p: F.arrays_overlap(tokens(p), terms))

    def mark(piece: Column) -> Column:
        runs = F.regexp_extract_all(piece, F.lit(TOKEN + r"|[^\p{L}\p{N}]+"), F.lit(0))
        wrapped = F.transform(
            runs,
            lambda w: F.when(F.array_contains(terms, F.lower(w)), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w),
        )
        return F.array_join(wrapped, "")

    return F.transform(F.slice(hits, 1, fragments), mark)


# ---------------------------------------------------------------- ranked legs


def bm25_scores(docs: DataFrame, q: str, text: str, id_col: str, filters: Filters | None = None) -> DataFrame:
    """(id, `score`) by BM25 of the documents whose text contains a query term; null where no word equals one.

    Document count, mean length and per-term document counts are one aggregate over the text column, read
    back as a scalar subquery; scoring is a second scan, in which only texts that contain a term are cut into
    words. Scores are rounded, so that summation order cannot flip a tie.
    """
    terms = query_terms(q)
    if not terms:
        return docs.select(id_col, F.lit(None).cast("double").alias("score")).where(F.lit(False))
    n_tokens = F.size("_t")
    stats = (
        docs.select(tokens(text).alias("_t"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg(n_tokens).alias("avgdl"),
            *[F.count_if(F.array_contains("_t", t)).cast("double").alias(f"df{i}") for i, t in enumerate(terms)],
        )
        .select(F.struct("n", "avgdl", *[f"df{i}" for i in range(len(terms))]).alias("s"))
        .scalar()
    )
    near = F.lit(False)
    for t in terms:
        near = near | F.lower(col(text)).contains(t)
    counted = (
        search_filters(docs, filters)
        .where(near)
        .select(id_col, tokens(text).alias("_t"))
        .select(
            id_col,
            n_tokens.alias("_dl"),
            *[(n_tokens - F.size(F.array_remove("_t", t))).alias(f"_tf{i}") for i, t in enumerate(terms)],
            stats.alias("_s"),
        )
    )
    n, avgdl = F.col("_s.n"), F.col("_s.avgdl")
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_dl") / avgdl)
    score, hits = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        df, tf = F.col(f"_s.df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf / (tf + norm)).otherwise(F.lit(0.0))
        hits = hits + tf
    return counted.select(id_col, F.when(hits > 0, F.round(score, 6)).alias("score"))


def top_ranked(scored: DataFrame, size: int, id_col: str) -> DataFrame:
    """The best `size` scored rows by (score desc, id desc) with their 1-based `rank`."""
    best = scored.orderBy(F.col("score").desc_nulls_last(), F.col(id_col).desc()).limit(size)
    best = best.where(F.col("score").isNotNull())
    w = Window.orderBy(F.col("score").desc(), F.col(id_col).desc())  # at most `size` rows left
    return best.withColumn("rank", F.row_number().over(w))


def keyword_leg(
    docs: DataFrame, q: str, size: int = KEYWORD_LEG, id_col: str = "id", text: str = "searchable_text",
    filters: Filters | None = None,
) -> DataFrame:
    return top_ranked(bm25_scores(docs, q, text, id_col, filters), size, id_col)


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Exact cosine in doubles; null for a missing or wrongly sized vector or a zero norm."""
    v = col(vector)
    q = [float(x) for x in query]
    q_norm = float(np.sqrt(np.sum(np.square(q))))
    dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in q]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(v) == len(q), F.try_divide(dot, norm * F.lit(q_norm)))


def vector_leg(
    vectors: DataFrame, query: list[float], size: int = VECTOR_LEG, id_col: str = "id", vector: str = "embedding",
    filters: Filters | None = None,
) -> DataFrame:
    """Exact nearest neighbours by cosine: filters first, then score, then top-k."""
    scored = search_filters(vectors, filters).select(id_col, F.round(cosine(vector, query), 6).alias("score"))
    return top_ranked(scored, size, id_col)


def rrf(legs: list[DataFrame], k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (k + rank) over the legs, best first, ties by higher id."""
    rows = None
    for leg in legs:
        part = leg.select(F.col(id_col), (1.0 / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy(id_col).agg(F.sum("part").alias("score"))
    return fused.orderBy(F.col("score").desc(), F.col(id_col).desc())


def fused_page(
    fused: DataFrame, limit: int, after: tuple[float, str] | None = None, id_col: str = "id"
) -> DataFrame:
    """A page of a fused ranking, strictly after (score, id); `total` is the size of the whole ranking."""
    # The ranking holds at most the rows of its legs, so its size is counted beside them, without a second scan.
    rest = fused.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    if after is not None:
        score, last = after
        rest = rest.where((F.col("score") < score) | ((F.col("score") == score) & (F.col(id_col) < last)))
    return rest.orderBy(F.col("score").desc(), F.col(id_col).desc()).limit(limit)


def search_hybrid(
    docs: DataFrame,
    vectors: DataFrame,
    q: str,
    query: list[float] | None,
    limit: int = 30,
    after: tuple[float, str] | None = None,
    filters: Filters | None = None,
    id_col: str = "id",
    text: str = "searchable_text",
) -> DataFrame:
    """Keyword and vector legs fused; without a query vector the keyword leg alone decides.

    Vectors must carry the filter columns when filters are given.
    """
    legs = [keyword_leg(docs, q, id_col=id_col, text=text, filters=filters)]
    if query:
        legs.append(vector_leg(vectors, query, id_col=id_col, filters=filters))
    return fused_page(rrf(legs, id_col=id_col), limit, after, id_col)


def search_chunks(
    chunks: DataFrame, vectors: DataFrame, q: str, query: list[float] | None, k: int = ASK_CHUNKS
) -> DataFrame:
    """Hybrid search over document chunks (key `chunk_id`), keeping the fused score, best k."""
    top = search_hybrid(chunks, vectors, q, query, k, id_col="chunk_id", text="chunk_text").drop("total")
    return chunks.join(F.broadcast(top), "chunk_id")  # top holds at most k rows


def retrieve(
    run_docs: DataFrame,
    run_vectors: DataFrame,
    chunks: DataFrame,
    chunk_vectors: DataFrame,
    question: str,
    query: list[float] | None,
    runs_k: int = ASK_RUNS,
    chunks_k: int = ASK_CHUNKS,
) -> tuple[DataFrame, DataFrame]:
    """What a question is answered from: the best runs and the best chunks, ranked by one query vector."""
    top = search_hybrid(run_docs, run_vectors, question, query, runs_k).drop("total")
    runs = run_docs.join(F.broadcast(top), "id")  # top holds at most runs_k rows
    return runs, search_chunks(chunks, chunk_vectors, question, query, chunks_k)


def hit_coverage(hits: DataFrame) -> DataFrame:
    """Share of retrieved runs that are priced; 0 when nothing was retrieved."""
    priced = F.avg(F.when(F.col("pricing_status") == "Priced", 1.0).otherwise(0.0))
    return hits.agg(F.coalesce(priced, F.lit(0.0)).alias("coverage"))


# ---------------------------------------------------------------- embeddings


def embedding_text(messages: DataFrame, docs: DataFrame, max_chars: int = EMBED_CHARS) -> DataFrame:
    """Per run the `role: content` lines of its non-blank messages in sequence order, cut to `max_chars`;
    runs without any fall back to their searchable text.

    A line takes at least four characters with its newline, so only the first max_chars / 4 + 1 lines can
    show. They are taken by a ranked filter that Spark applies before the shuffle as well, so no run ever
    collects more, however many messages it has.
    """
    lines = messages.where(~is_blank("content")).select(
        F.col("run_id").alias("id"),
        "sequence",
        F.left(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.col("content")), F.lit(max_chars)).alias("line"),
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy("sequence"))
    shown = lines.withColumn("_n", rank).where(F.col("_n") <= max_chars // 4 + 1)
    joined = shown.groupBy("id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("sequence", "line"))), lambda x: x["line"]), "\n"
        ).alias("_text")
    )
    text = F.coalesce("_text", F.coalesce("searchable_text", F.lit("")))
    return (
        docs.select("id", "searchable_text")
        .join(joined, "id", "left")
        .select("id", F.left(text, F.lit(max_chars)).alias("embedding_text"))
    )


Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dims: int = EMBED_DIMS) -> Embedder:
    """An embedder for tests and trials: signed hashed bag of words, unit length. Deterministic and model-free."""
    import zlib

    def embed_batch(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for word in re.findall(r"[^\W_]+", t.lower()):
                h = zlib.crc32(word.encode("utf-8"))
                out[i, h % dims] += 1.0 if (h >> 16) & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed_batch


def embed(df: DataFrame, text: str, embedder: Embedder, dims: int = EMBED_DIMS) -> DataFrame:
    """Adds `embedding` by calling the embedder on Arrow batches; a wrong width fails the job."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.asarray(embedder([t or "" for t in batch]), dtype=np.float32)
            if out.shape != (len(batch), dims):
                raise ValueError(f"embedder gave shape {out.shape}, expected ({len(batch)}, {dims})")
            yield pd.Series(list(out))

    return df.withColumn("embedding", vectors(F.col(text)))


def attach_vectors(docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Run documents with (embedding, embedding_text) set from `embedded` where it has the run, else kept."""
    fields = ("embedding", "embedding_text")
    new = embedded.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_new"))
    joined = docs.join(new, "id", "left")
    for f in fields:
        old = F.col(f) if f in docs.columns else F.lit(None)
        joined = joined.withColumn(f, F.when(F.col("_new"), F.col(f"_{f}")).otherwise(old))
    return joined.drop("_new", *[f"_{f}" for f in fields])
