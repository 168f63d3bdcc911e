"""From retrieval hits to redacted prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom.functions.redaction import redact


def redact_runs(hits: DataFrame) -> DataFrame:
    """Allow-listed run fields with a redacted excerpt; workspace and external id values are denied."""
    return hits.select(
        F.col("id").alias("run_id"),
        "session_id",
        "persona",
        "model_slug",
        "status",
        "started_at",
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
        "cost_usd",
        redact("searchable_text", ["workspace", "external_id"]).alias("excerpt"),
    )


def redact_chunks(hits: DataFrame) -> DataFrame:
    return hits.select("uri", "title", "ordinal", redact("chunk_text").alias("excerpt"))


def _iso(at: str) -> Column:
    """Round-trip time format with seven fraction digits and the UTC offset."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def run_line() -> Column:
    def part(label: str, value: Column) -> list[Column]:
        return [F.lit(label), value]

    unknown = F.lit("unknown")
    pieces = [
        *part("- run_id: ", F.col("run_id")),
        *part(" | session_id: ", F.col("session_id")),
        *part(" | persona: ", F.coalesce("persona", unknown)),
        *part(" | model: ", F.coalesce("model_slug", unknown)),
        *part(" | status: ", F.col("status")),
        *part(" | started_at: ", F.coalesce(_iso("started_at"), unknown)),
        *part(" | tokens: ", F.col("tokens").cast("string")),
        *part(" | cost: ", F.coalesce(F.col("cost_usd").cast("string"), F.lit("0"))),
        *part(" | excerpt: ", F.col("excerpt")),
    ]
    return F.concat(*pieces)


def chunk_line() -> Column:
    """Document citation line; the uri never appears in it."""
    return F.concat(
        F.lit("- title: "), F.col("title"),
        F.lit(" | ordinal: "), F.col("ordinal").cast("string"),
        F.lit(" | excerpt: "), F.col("excerpt"),
    )


def _section(lines: DataFrame, title: str) -> DataFrame:
    """Lines (question_id, question, rank, line) of one kind to one block per question; hits are top-k bounded."""
    return lines.groupBy("question_id").agg(
        F.concat(
            F.lit(title),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))),
                "",
            ),
        ).alias("_block")
    )


def assemble_context(questions: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One prompt per question: the question, then run citations, then document citations, each in rank order.

    `questions` are (question_id, question); `runs` and `chunks` are redacted hits with question_id and rank.
    """
    run_block = _section(runs.withColumn("line", run_line()), "Trace citations:\n").withColumnRenamed("_block", "_runs")
    chunk_block = _section(chunks.withColumn("line", chunk_line()), "Document citations:\n").withColumnRenamed("_block", "_chunks")
    empty = F.lit("")
    return (
        questions.join(run_block, "question_id", "left")
        .join(chunk_block, "question_id", "left")
        .select(
            "question_id",
            F.concat(
                F.lit("Question: "), F.col("question"), F.lit("\n\n"),
                F.coalesce("_runs", empty), F.coalesce("_chunks", empty),
            ).alias("context"),
        )
    )
