"""Rows that every operator must take: nulls anywhere, empty and very long texts, ties, repeats, clashing columns."""

LONG = "lorem ipsum dolor " * 40_000
ODD = [
    (1, "a few words of plain text here", "en", "s1", 30),
    (1, "a few words of plain text here", "en", "s1", 30),
    (2, "", "en", "s1", 0),
    (3, None, None, None, None),
    (None, "no id but some words", "en", "s2", 20),
    (4, LONG, "en", "s2", len(LONG)),
    (5, " \t\n\r\x0b\x0c ", "en", "s2", 7),
    (6, "ünï çödé 漢字 🙂 \u00a0 x", "xx", "s3", 20),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use in their results.
CLASH = ["n", "n_shingles", "component_id", "kept", "size", "taken", "target", "ids", "spans", "score", "id", "values", "comp", "regs", "at", "quality", "toxic"]


def odd_docs(spark):
    df = spark.createDataFrame(ODD, DDL)
    for c in CLASH:
        df = df.withColumn(c, df.n_chars)
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DDL)
