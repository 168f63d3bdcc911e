"""Ranked words for guess costs: those of a tokenizer's vocabulary file, and the corpus' own.

Vocabulary files list their tokens by rank, frequent ones first; tokens that are whole words are a ranked lexicon. The
corpus' words are counted by a Spark job over all documents, so that the languages of the corpus are known too.
"""

from __future__ import annotations

import base64
import json
from itertools import zip_longest

from pyspark.sql import DataFrame, functions as F

from costloom.session import stage

# Bounds of what goes to the tasks: words of the corpus, and letters of a word.
CORPUS_WORDS = 50_000
SHORTEST, LONGEST = 3, 24
# A corpus word stands in so many documents at least: what a single document repeats is no word of the language.
LEAST_DOCUMENTS = 3


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a vocabulary file in order of rank: `.tiktoken` tokens that start with a blank, or tokens of a `.json`
    model that end a word."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        tokens = [t[: -len("</w>")] for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>")]
    else:
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        tokens = [b[1:].decode("utf-8", "replace") for _, b in ranked if b.startswith(b" ")]
    words = [t.lower() for t in tokens if t.isalpha() and SHORTEST <= len(t) <= LONGEST]
    return list(dict.fromkeys(words))


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The words that stand in most documents, commonest first, ties by the word: at most `most`, without the last count of
    documents that would exceed it.

    Counted over all documents with map-side combine; null and empty texts have none. How many words have a count decides from
    which count on words are fetched, so no more than `most` of them ever reach the driver. An empty table gives no words.
    """
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.select(F.explode(F.array_distinct(F.split(low, r"[^\p{L}]+"))).alias("word"))
    counted = own.where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted.where(F.col("n") >= LEAST_DOCUMENTS), "corpus-words")
    least, held = None, 0
    for n, words in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        held += words
        if held > most:
            break
        least = n
    if least is None:
        return []
    rows = counted.where(F.col("n") >= least).collect()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def ranks(first: list[str], *lists: list[str]) -> dict[str, int]:
    """word -> rank from 1: `first` in its order, then the others' words in turns."""
    out: dict[str, int] = {}
    for word in first:
        out.setdefault(word, len(out) + 1)
    for row in zip_longest(*lists):
        for word in row:
            if word is not None:
                out.setdefault(word, len(out) + 1)
    return out
