"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and an exact check.

A document's set holds the digests of its distinct word shingles. Register i keeps the least of the set's
exponential variates under hash i, on a truncated scale with base `BASE`: registers of a union are the larger
ones of both sides, and two registers agree with a chance close to the Jaccard similarity.

1. Rows with equal sets form one class; only one row per class goes on. A text that is copied a million times
   is one class.
2. Registers are cut into bands. Classes that agree on a band share a bucket.
3. Every class of a bucket is compared with the bucket's representative (star edges, at most linear); large buckets that
   still hold several components of the links confirmed so far go through some more rounds with other ones.
4. In buckets that hold several components after that every pair of classes from different components is compared, in
   tiles of bounded size. Pairs inside one component can no longer change a result, so nothing is lost. A tile gives its
   components and the rows that pass, at most linear in its rows, so a group of copies never produces its pairs.
5. Candidates must pass a joint maximum-likelihood estimate of the similarity, with a wide margin, then the
   exact test on full sets.

Chances at the defaults: a pair at similarity 0.8 shares no band with probability 2e-9 (51 bands of 5), and falls below
the estimate's margin (six standard errors) with 1e-9; more similar pairs are safer still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costloom.llm import wordhash
from costloom.llm.components import connected_components
from costloom.session import bound_batches, stage

BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
REGISTERS = 255
ROWS = 5
SEED = 20_231
# Low bits of a bucket's key.
BAND_MASK = 63
# Orders by which representatives are chosen: ids xor a salt. One unlucky choice does not split a group.
SALTS = [0, 0x2F6E2B1D5A9C3E71, 0x5DEECE66D1B54A33, 0x7A3C1F0B9E2D4C65]
# Lists of ids up to this length are broadcast, so that texts stay where they are; longer ones are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
# Further rounds of one representative for each bucket of more than a tile that still holds several components.
MORE_SALTS = [None, 0x1C69B3F74AC4AE35, 0x3A5F0E9D27B86C41]
# Rows and set elements of one side of a tile in the cross-component comparison.
TILE, TILE_ELEMENTS = 1024, 1_000_000
# Elements x registers hashed at a time: bounds the memory of a very long text.
CHUNK = 2048


def multipliers(m: int = REGISTERS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Least hash per register; the least over parts of a set is the least over the set."""
    out = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), CHUNK):
        np.minimum(out, np.multiply.outer(values[at : at + CHUNK], mult).min(axis=0), out=out)
    return out


def truncate(least: np.ndarray) -> np.ndarray:
    """Register values floor(1 - log_BASE(x)), kept in 0..TOP + 1, of exponential minima x."""
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 63-bit key per band, of an array (..., registers); its low bits are the band's number."""
    bands = regs.shape[-1] // rows
    cut = regs[..., : bands * rows].reshape(*regs.shape[:-1], bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:-1]).copy()
    for i in range(rows):
        key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[..., i] + np.uint64(1))
    key = (key >> np.uint64(1)) & ~np.uint64(BAND_MASK) | np.arange(bands, dtype=np.uint64)
    return key.astype(np.int64)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes.

    The counts of registers that are larger on the left, larger on the right and equal have probabilities
    p(u - vJ), p(v - uJ) and the rest, where u, v are the shares of the sizes and p(x) = -log_b(1 - x(b-1)/b).
    The log-likelihood is concave in J; a ternary search over all pairs at once finds its maximum.
    """
    up = (a > b).sum(axis=1).astype(np.float64)
    down = (a < b).sum(axis=1).astype(np.float64)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        pu, pd_ = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(pu + tiny) + down * np.log(pd_ + tiny) + same * np.log(np.maximum(1 - pu - pd_, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (hi - lo) / 3
        right = score(lo + third) < score(hi - third)
        lo, hi = np.where(right, lo + third, lo), np.where(right, hi, hi - third)
    return (lo + hi) / 2


def _margin(threshold: float, m: int) -> float:
    return 6 * (threshold * (1 - threshold) / m) ** 0.5


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, j: float) -> np.ndarray:
    """Pairs whose maximum-likelihood estimate is at least j: the slope of the (concave) log-likelihood at j is not
    negative. One evaluation in place of a search. j must be possible for the sizes."""
    up = (a > b).sum(axis=1).astype(np.float64)
    down = (a < b).sum(axis=1).astype(np.float64)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    c = (BASE - 1) / BASE
    x, y = np.clip(u - v * j, 0, 1), np.clip(v - u * j, 0, 1)
    p, q = -np.log1p(-x * c) / np.log(BASE), -np.log1p(-y * c) / np.log(BASE)
    dp, dq = c / np.log(BASE) / (1 - x * c), c / np.log(BASE) / (1 - y * c)
    tiny = 1e-12
    slope = same * (v * dp + u * dq) / np.maximum(1 - p - q, tiny) - up * v * dp / (p + tiny) - down * u * dq / (q + tiny)
    return slope >= 0


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose estimate is not far below it."""
    ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    if ok.any():
        at = np.flatnonzero(ok)
        ok[at] = reaches(a[at], b[at], na[at].astype(float), nb[at].astype(float), threshold - _margin(threshold, a.shape[1]))
    return ok


def sketch(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, d1, d2, regs): set size, 128-bit digest of the set and its registers, one row per document."""
    mult = multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wordhash.WordIds()
        for batch in batches:
            for part in wordhash.pieces(batch, 1):
                n, d1, d2, regs = [], [], [], []
                for text in wordhash.as_bytes(part.column(1)):
                    values = np.unique(wordhash.shingles(ids.of((text or b"").lower().split()), words))
                    x, y = wordhash.set_digest(values)
                    n.append(len(values)), d1.append(x), d2.append(y)
                    regs.append(truncate(minima(values, mult)).tobytes() if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "regs"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(wordhash.released(run), "doc_id long, n long, d1 long, d2 long, regs binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, d1, values): the full sets of the documents, empty ones left out, each set of an id once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wordhash.WordIds()
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for part in wordhash.pieces(batch, 1):
                names, d1, sets = [], [], []
                for name, text in zip(part.column(0).to_pylist(), wordhash.as_bytes(part.column(1))):
                    values = np.unique(wordhash.shingles(ids.of((text or b"").lower().split()), words))
                    digest = wordhash.set_digest(values)[0]
                    if len(values) and (name, digest) not in given:
                        if len(given) >= MAX_BROADCAST_IDS:
                            given.clear()
                        given.add((name, digest))
                        names.append(name), d1.append(digest), sets.append(values)
                if sets:
                    cut = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                    values = pa.ListArray.from_arrays(cut, pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(d1, pa.int64()), values], ["id", "d1", "values"])

    return docs.mapInArrow(wordhash.released(run), "id long, d1 long, values array<long>")


def _sets_of(reps: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, values) of `ids` (distinct, staged), each set of an id once."""
    sets = stage(_sets(_texts_of(reps, ids), words), "neardup-sets")
    if not sets.groupBy("id", "d1").count().where("count > 1").isEmpty():
        sets = stage(sets.dropDuplicates(["id", "d1"]), "neardup-sets")
    return sets.select("id", "values")


def _bands(classes: DataFrame) -> DataFrame:
    """(bkey, id): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(regs)
            owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(owner)], ["bkey", "id"])

    return classes.select("id", "regs").mapInArrow(wordhash.released(run), "bkey long, id long")


def _texts_of(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of `ids` (distinct, staged)."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return reps.join(ids, "id", "left_semi").select("id", "text")


def _screen(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that pass sizes and the joint estimate."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").where(
        F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            ok = pa.array(passes(a, b, na, nb, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(wordhash.released(run), "a long, b long")


def _confirm(pairs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union.

    Sets are made again from the texts of the classes that occur in a pair; the text side of that join carries
    each representative once.
    """
    ids = stage(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "neardup-ids")
    sets = _sets_of(reps, ids, words)
    left = sets.select(F.col("id").alias("a"), F.col("values").alias("va"))
    right = sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
    both = F.size(F.array_intersect("va", "vb")).cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("va") + F.size("vb") - both))
        .select("a", "b")
    )


def _blocked(rows: DataFrame, key: str, tile: int) -> DataFrame:
    """`rows` (key, id, comp, n) with `major`, whether their component is the group's largest, and the numbers of blocks of
    the rows outside (`few`) and inside it (`many`): at most about `tile` rows and TILE_ELEMENTS elements a block."""
    by_comp = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    whole = by_comp.groupBy(key).agg(F.max(F.struct("rows", "elements", "comp")).alias("most"), F.sum("rows").alias("rows"), F.sum("elements").alias("elements"))
    blocks = lambda r, e: F.greatest(F.ceil(r / F.lit(tile)), F.ceil(e / F.lit(TILE_ELEMENTS)), F.lit(1)).cast("int")
    dealt = whole.select(
        key,
        F.col("most.comp").alias("largest"),
        blocks(F.col("rows") - F.col("most.rows"), F.col("elements") - F.col("most.elements")).alias("few"),
        blocks(F.col("most.rows"), F.col("most.elements")).alias("many"),
    )
    return rows.join(dealt, key).withColumn("major", F.col("comp") == F.col("largest")).drop("largest")


def _tiles(members: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Rows of `members` (key, id, comp, major, few, many, ...) dealt to pairs of blocks, sorted so that a pair is contiguous.

    Blocks 0 .. few - 1 hold the rows outside the group's largest component, the rest those inside it. Two rows of which one at
    least lies outside meet in exactly one tile; two inside need no comparison. A task holds one tile at a time, so memory
    does not grow with a group, and a group with few rows outside is copied few times.
    """
    deal = F.xxhash64("id")
    own = F.when(F.col("major"), F.col("few") + F.pmod(deal, F.col("many"))).otherwise(F.pmod(deal, F.col("few"))).cast("int")
    others = F.when(F.col("major"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select(key, F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "id", "comp", *carried)
        .repartition(key, "ti", "tj")
        .sortWithinPartitions(key, "ti", "tj")
    )


Tile = dict[str, np.ndarray]


def _per_tile(key: str, work: Callable[[Tile], Iterator[pd.DataFrame]]):
    """mapInPandas function that hands every tile (contiguous rows) to `work` as its columns, which yields frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Tile | None = None
        for part in batches:
            now = {c: part[c].to_numpy() for c in part.columns}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            n = len(now[key])
            if not n:
                continue
            new = np.flatnonzero((now[key][1:] != now[key][:-1]) | (now["ti"][1:] != now["ti"][:-1]) | (now["tj"][1:] != now["tj"][:-1])) + 1
            cuts = [0, *new.tolist()]
            for at, upto in zip(cuts, cuts[1:]):
                yield from work({c: v[at:upto] for c, v in now.items()})
            held = {c: v[cuts[-1] :] for c, v in now.items()}
        if held is not None:
            yield from work(held)

    return run


def _cross_rows(tile: Tile) -> Iterator[tuple[int, np.ndarray]]:
    """(i, positions): every pair of rows of the tile from different components and, in a mixed tile, different
    blocks, seen once. Only rows outside the tile's largest component are visited."""
    own, comp = tile["own"], tile["comp"]
    if (comp == comp[0]).all():
        return
    names, at, counts = np.unique(comp, return_inverse=True, return_counts=True)
    minor = at != np.argmax(counts)
    visited = np.zeros(len(comp), bool)
    for i in np.flatnonzero(minor):
        meets = (comp != comp[i]) & ~visited
        if tile["ti"][0] != tile["tj"][0]:
            meets &= own != own[i]
        visited[i] = True
        if meets.any():
            yield int(i), np.flatnonzero(meets)


class _Forest:
    """Components met in a tile; `roots` names each joined one beside the least it was joined with."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _clusters(members: DataFrame, threshold: float) -> DataFrame:
    """What the rows of mixed buckets give: (a, b, null) for components that passing estimates join, and (null, null, id)
    for rows that have such a pair.

    `members` is (bkey, id, comp, n, regs, ...). A tile gives a star over its components, at most one row for each, and
    its rows once; never the pairs. A pair is looked at in its first common band only.
    """

    def work(tile: Tile) -> Iterator[pd.DataFrame]:
        regs = keys = None
        n, ids, comp, band = tile["n"], tile["id"], tile["comp"], int(tile["bkey"][0]) & BAND_MASK
        forest, met = _Forest(), np.zeros(len(ids), bool)
        for i, at in _cross_rows(tile):
            at = at[np.minimum(n[at], n[i]) >= threshold * np.maximum(n[at], n[i]) - 1e-9]
            if not len(at):
                continue
            if regs is None:
                regs = np.frombuffer(b"".join(tile["regs"]), np.uint16).reshape(len(ids), -1)
            at = at[passes(np.broadcast_to(regs[i], (len(at), regs.shape[1])), regs[at], np.full(len(at), n[i]), n[at], threshold)]
            if band and len(at):
                if keys is None:
                    keys = band_keys(regs[:, : band * ROWS])
                at = at[~(keys[at] == keys[i]).any(axis=1)]
            if len(at):
                met[at] = met[i] = True
                for c in np.unique(comp[at]):
                    forest.join(int(comp[i]), int(c))
        if met.any():
            a, b = zip(*forest.roots())
            own = np.unique(ids[met])
            yield pd.DataFrame({
                "a": pd.array([*a, *[None] * len(own)], "Int64"), "b": pd.array([*b, *[None] * len(own)], "Int64"), "id": pd.array([*[None] * len(a), *own], "Int64"),
            })

    return _tiles(members, "bkey", ["n", "regs"]).mapInPandas(wordhash.released(_per_tile("bkey", work)), "a long, b long, id long").distinct()


def _cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) confirmed links between different components, a spanning forest of them per tile.

    `members` is (cluster, id, comp, values, ...). All sets of a tile are laid in one array; one row's
    intersection with every other row is one pass over it.
    """

    def work(tile: Tile) -> Iterator[pd.DataFrame]:
        ids, comp, sizes = tile["id"], tile["comp"], np.array([len(v) for v in tile["values"]])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = None
        forest = _Forest()
        edges: list[tuple[int, int]] = []
        for i, at in _cross_rows(tile):
            if flat is None:
                known, flat = np.unique(np.concatenate(list(tile["values"])), return_inverse=True)
                mark = np.zeros(len(known), bool)
            mark[flat[starts[i] : starts[i + 1]]] = True
            both = np.add.reduceat(mark[flat].astype(np.int64), starts[:-1])[at]
            mark[flat[starts[i] : starts[i + 1]]] = False
            edges += [(i, int(j)) for j in at[100 * both >= percent * (sizes[i] + sizes[at] - both)] if forest.join(int(comp[i]), int(comp[j]))]
        if edges:
            e = np.array(edges)
            yield pd.DataFrame({"a": ids[e[:, 0]], "b": ids[e[:, 1]]})

    return _tiles(members, "cluster", ["values"]).mapInPandas(wordhash.released(_per_tile("cluster", work)), "a long, b long")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bkey, id, comp) of the buckets of `members` (bkey, id) that hold several components."""
    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bkey", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bkey")
    return stage(placed.join(mixed, "bkey", "left_semi"), "neardup-mixed")


def _star(held: DataFrame, salt: int | None, tile: int) -> DataFrame:
    """(a, b): each row of a mixed bucket of more than `tile` rows beside one row of the bucket, where their components differ.

    That row is the bucket's least under a salt; or, without one, the row that shares its buckets with most others:
    copies that differ from each other in different places meet in the text that they all were made from.
    """
    sizes = held.groupBy("bkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    large = held.join(sizes, "bkey")
    if salt is None:
        weights = large.groupBy("id").agg(F.sum("n").alias("w"))
        large, chosen = large.join(weights, "id"), F.struct(-F.col("w"), "id")
    else:
        chosen = F.col("id").bitwiseXOR(F.lit(salt))
    heads = large.groupBy("bkey").agg(F.min_by(F.struct(F.col("id").alias("head"), F.col("comp").alias("over")), chosen).alias("h")).select("bkey", "h.*")
    return held.join(heads, "bkey").where("comp <> over").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile: int = TILE,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased; a set holds the distinct shingles of `words`
    words, or the whole sequence where there are fewer. Documents are linked at Jaccard similarity of at least
    percent / 100, confirmed on full sets; component_id is the least doc_id reachable and kept marks its row.

    Null or empty texts and texts without words: empty set, linked with nothing, kept. Null ids: returned with
    their set size, no component, kept, linked with nothing. Rows of one id share its component, also where their texts
    differ (an empty one among them keeps its own id). Texts of any length are taken whole. An empty table gives no rows;
    extra columns are ignored.
    """
    threshold = percent / 100
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(sketch(narrow, words), "neardup-sketch")
    sized = rows.where("n > 0 and doc_id is not null")
    least = stage(sized.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "neardup-class")
    classes = stage(
        sized.join(least.withColumnRenamed("id", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), "n", "regs", "d1", "d2")
        .dropDuplicates(["id", "d1", "d2"]),
        "neardup-registers",
    )
    # Texts of class representatives; copies of them are not needed again.
    reps = narrow.withColumnRenamed("doc_id", "id")
    # An id with several sets is one node.
    several = sized.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = stage(
        sized.select("doc_id", "d1", "d2").join(several, "doc_id", "left_semi").join(least, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct(),
        "neardup-same-id",
    )

    bands = _bands(classes)
    salted = F.col("id").bitwiseXOR(F.element_at(F.array(*map(F.lit, SALTS)), (F.col("bkey").bitwiseAND(F.lit(len(SALTS) - 1)) + 1).cast("int")))
    heads = (
        bands.groupBy("bkey")
        .agg(F.min(salted).alias("id"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("bkey", salted.alias("head"))
    )
    members = stage(bands.join(heads, "bkey"), "neardup-members")
    star = members.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    tested = stage(_screen(star, classes, threshold), "neardup-star")
    links = same_id.unionAll(stage(_confirm(tested, reps, words, percent), "neardup-links"))
    labels = connected_components(links)
    held = _mixed(members, labels)
    for salt in MORE_SALTS:
        # A bucket of one tile is compared as it is below; larger ones are thinned out first.
        again = stage(_star(held, salt, tile), "neardup-again")
        if again.isEmpty():
            break
        more = stage(_confirm(stage(_screen(again, classes, threshold), "neardup-star"), reps, words, percent), "neardup-links")
        if more.isEmpty():
            break
        links = links.unionAll(more)
        labels = connected_components(links)
        # A bucket of one component stays one.
        held = _mixed(held, labels)

    found = stage(_clusters(_blocked(held.join(classes.select("id", "n", "regs"), "id"), "bkey", tile), threshold), "neardup-clusters")
    joined = connected_components(found.where("id is null").select("a", "b"), "neardup-joined")
    met = stage(found.where("id is not null").select("id"), "neardup-met")
    grouped = (
        met.join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("id", F.coalesce("component", "id").alias("comp"))
        .join(joined.select(F.col("node").alias("comp"), F.col("component").alias("cluster")), "comp")
        .join(_sets_of(reps, met, words), "id")
        .withColumn("n", F.size("values").cast("long"))
    )
    more = stage(_cluster_links(_blocked(stage(grouped, "neardup-grouped"), "cluster", tile), percent), "neardup-more")
    final = labels if more.isEmpty() else connected_components(links.unionAll(more))

    reach = least.join(final.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    known = rows.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("d1")).alias("d1"), "d2").join(reach, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return known.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with `_node`: the id, or a number beyond all ids for each text of an id that stands on several texts."""
    whole = docs.withColumn("_node", F.col(id_col).cast("long"))
    repeated = stage(whole.where("_node is not null").groupBy("_node").count().where("count > 1").select("_node"), "neardup-repeated")
    if repeated.isEmpty():
        return whole
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("_digest")
    texts = stage(whole.join(repeated, "_node", "left_semi").select("_node", digest).distinct(), "neardup-texts")
    several = texts.groupBy("_node").count().where("count > 1").select("_node")
    least, most = whole.agg(F.min("_node"), F.max("_node")).first()
    step = F.monotonically_increasing_id()
    new = step + F.lit(most + 1) if most < 2**62 else F.lit(least - 1) - step
    ordered = texts.join(several, "_node", "left_semi").repartitionByRange("_node", "_digest").sortWithinPartitions("_node", "_digest")
    numbered = stage(ordered.withColumn("_new", new), "neardup-numbered")
    if numbered.isEmpty():
        return whole
    ids = numbered.select("_node").distinct()
    own = whole.withColumn("_digest", digest).join(numbered, ["_node", "_digest"]).withColumn("_node", F.col("_new"))
    return whole.join(ids, "_node", "left_anti").select(*docs.columns, "_node").unionByName(own.select(*docs.columns, "_node"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that lead their groups, with their columns: one row of each group of near copies.

    The least id of a group stays. Texts that share an id are judged each on its own, after all other ids, so that a text
    which stands nowhere else is never lost; of rows that repeat one id and text, the one whose columns come first as
    JSON stays. Rows without an id stay. Rows that go are taken out by an anti-join with their ids, the smaller list in a corpus
    of mostly different texts.
    """
    named = _apart(docs, id_col, text_col)
    groups = stage(near_duplicates(named, words, percent, "_node", text_col), "neardup-groups")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_node")).distinct()
    left = named.join(gone, "_node", "left_anti").select(*docs.columns, "_node")
    again = stage(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_node")), "neardup-repeats")
    if again.isEmpty():
        return left.drop("_node")
    row = F.struct(*docs.columns)
    one = left.join(again, "_node", "left_semi").groupBy("_node").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return left.join(again, "_node", "left_anti").drop("_node").unionByName(one)
