"""Benchmark decontamination by winnowing, in SQL functions only.

A text's words give one hash per GRAM consecutive words. Of every WINDOW consecutive hashes the least one is kept (all of
them where they tie); these are the text's fingerprints. Two texts that share SPAN = WINDOW + GRAM - 1 words share all hashes
of a window, keep its least one at the same place, and so share a fingerprint: no shared span of SPAN words is missed.

1. The benchmark's fingerprints go into a bitmap of bounded size. A document's hashes are tested against it inside the row,
   and only those that may match are tested for being the least of a window and leave the row, with the words around them.
2. Fingerprints of both sides are joined.
3. A hit is extended: every window of SPAN words that holds the hit is joined with the benchmark's windows by its
   words, so hashes decide nothing. Documents carry the windows that matched; no pair of texts is ever laid side by side.

Items of fewer than SPAN words are one window of their own: their whole hash is the fingerprint (a window of one hash), looked
for where their first word stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom.session import stage

GRAM, SPAN = 5, 10
WINDOW = SPAN - GRAM + 1
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bits of a bitmap per fingerprint, and bounds of its size as powers of two: 2 MB at most. Beyond that more hashes pass it in
# vain, and the join drops them.
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 16, 24
# Rows of the benchmark's side up to which it is broadcast (some 30 MB of windows); longer lists are joined by a shuffle.
MAX_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Maximal runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z alone; a null text has none."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column) -> Column:
    """A hash per GRAM consecutive word hashes."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (GRAM - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, GRAM))))


def _is_least(grams: Column, p: Column) -> Column:
    """Whether the hash at p is the least of a window of WINDOW hashes around it; texts have one window at least."""
    first, last = F.greatest(p - (WINDOW - 1), F.lit(0)), F.least(p, F.size(grams) - WINDOW)
    return F.exists(F.sequence(first, last), lambda i: F.array_min(F.slice(grams, i + 1, F.lit(WINDOW))) >= F.get(grams, p))


class Bitmap:
    """A bitmap of the hashes in `rows` (h), as a literal of the plan."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
        self.mask = 2 ** (power - 6) - 1
        word = self._word(F.col("h")).alias("w")
        set_bits = rows.select(word, F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b"))
        held = dict(map(tuple, set_bits.collect()))
        text = ",".join(str(held.get(i, 0)) for i in range(self.mask + 1))
        self.bits = F.split(F.lit(text), ",").cast("array<bigint>")

    def _word(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.mask)).cast("int")

    def may_hold(self, h: Column) -> Column:
        return F.getbit(F.get(self.bits, self._word(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _bounded(rows: DataFrame) -> DataFrame:
    """Staged rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, hashes, k): k is the length of the item's windows."""
    cut = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    return stage(cut.select("item_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.least(F.size("words"), F.lit(SPAN)).alias("k")), "decontam-items")


def _fingerprints(items: DataFrame) -> DataFrame:
    """(k, h) of all items, each once."""
    long = items.where(F.col("k") == SPAN).select("k", _grams(F.col("hashes")).alias("grams"))
    kept = F.filter(_range(F.size("grams")), lambda p: _is_least(F.col("grams"), p))
    long = long.select("k", F.explode(F.transform(kept, lambda p: F.get("grams", p))).alias("h"))
    return long.unionAll(items.where(F.col("k") < SPAN).select("k", F.xxhash64("hashes").alias("h"))).distinct()


def _hits(docs: DataFrame, items: DataFrame, prints: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, hits): one row per document; hits are (k, h, start, words): hashes that may match a
    fingerprint for windows of k words, and the words of all windows around them."""
    cut = docs.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words"))
    around = lambda p, first, last, k, h: F.struct(
        F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"),
        h.alias("h"),
        first.alias("start"),
        F.array_join(F.slice("words", first + 1, last - first + 1), " ").alias("words"),
    )
    bits = Bitmap(prints.where(F.col("k") == SPAN).select("h"))
    cut = cut.withColumn("grams", F.when(F.col("n_words") >= SPAN, _grams(F.col("hashes"))).otherwise(F.array().cast("array<bigint>")))
    cut = cut.withColumn("maybe", F.filter(_range(F.size("grams")), lambda p: bits.may_hold(F.get("grams", p))))
    least = F.filter("maybe", lambda p: _is_least(F.col("grams"), p))
    hits = F.transform(
        least,
        lambda p: around(p, F.greatest(p - (WINDOW - 1), F.lit(0)), F.least(p + (SPAN - 1), F.col("n_words") - 1), SPAN, F.get("grams", p)),
    )
    short = sorted(r.k for r in items.where(F.col("k") < SPAN).select("k").distinct().collect())
    if short:
        firsts = Bitmap(items.where(F.col("k") < SPAN).select(F.get("hashes", F.lit(0)).alias("h")).distinct())
        wholes = Bitmap(prints.where(F.col("k") < SPAN).select("h"))
        cut = cut.withColumn("firsts", F.filter(_range(F.col("n_words")), lambda p: firsts.may_hold(F.get("hashes", p))))
        hash_at = lambda p, k: F.xxhash64(F.slice("hashes", p + 1, F.lit(k)))
        for k in short:
            found = F.filter("firsts", lambda p: (p + k <= F.col("n_words")) & wholes.may_hold(hash_at(p, k)))
            hits = F.concat(hits, F.transform(found, lambda p: around(p, p, p + (k - 1), k, hash_at(p, k))))
    return stage(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", hits.alias("hits")), "decontam-hits")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A window is SPAN consecutive words of an item, or all words of a shorter one. A word of a document is hit if it lies
    inside any occurrence of a window; items are those with such windows, as strings in order.

    Null and empty texts have no words, no hits and no windows. Rows of one id are judged one by one; repeated items count
    once. An item without an id marks words and is not listed. Texts of any length are taken whole: they stay where they are read,
    only hits travel. Empty tables on either side give no rows or no hits; extra columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_id_col, item_text_col)
    prints = stage(_fingerprints(items), "decontam-prints")
    rows = _hits(narrow, items, prints)
    at = lambda i: F.array_join(F.slice("words", i + 1, F.col("k")), " ")
    windows = stage(items.select("item_id", "k", F.explode(F.transform(_range(F.size("words") - F.col("k") + 1), at)).alias("window")).distinct(), "decontam-windows")

    met = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(_bounded(prints), ["k", "h"], "left_semi")
    around = met.select("row", "k", "start", F.split("words", " ").alias("words"))
    spread = around.select("row", "k", "start", F.posexplode(F.transform(_range(F.size("words") - F.col("k") + 1), at)).alias("i", "window"))
    spans = spread.select("row", "k", (F.col("start") + F.col("i")).alias("start"), "window")
    found = stage(spans.join(_bounded(stage(windows.select("k", "window").distinct(), "decontam-distinct")), ["k", "window"], "left_semi").distinct(), "decontam-found")

    ends = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end"))))
    # Words under the spans, each once: a span adds what reaches beyond all spans before it.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hit = found.groupBy("row").agg(ends.alias("spans")).select("row", covered.alias("n_hit"))
    listed = (
        found.select("row", "k", "window").distinct().join(_bounded(windows), ["k", "window"]).where("item_id is not null")
        .select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.select("row", "doc_id", "n_words")
        .join(hit, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items_or_none).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_or_none, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            items_or_none.alias("items"),
        )
    )
