"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Unit vectors are projected on Gaussian directions (2-stable) and cut into cells of width `WIDTH`; `DIRECTIONS` cells make a
bucket, `TABLES` independent tables hold every vector. For a query with projection x, a neighbour at cosine c has a
projection that is normal with mean c x and variance 1 - c^2, so each cell has a known chance; buckets are visited in falling
order of their product until the chances reach `SUCCESS` per table. c is fitted: a low quantile of the cosine of the K-th
neighbour over a bounded sample of queries, each compared exactly with every vector.

A bucket's vectors come together with the queries that probe it, in tiles of bounded size; each tile gives a query its best
rows by exact cosine, so candidates never leave it as pairs. Equal vectors are one class: its K + 1 least ids stand for all
ties. Queries that found fewer rows than there are get an exact pass.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.session import stage

TABLES = 2
DIRECTIONS = 4
WIDTH = 1.25
SUCCESS = 0.8
SEED = 11
# Queries of the fit, and the quantile of their K-th neighbour's cosine.
FIT_QUERIES = 64
FIT_QUANTILE = 0.1
# Rows of one side of a tile.
TILE = 4096
CELL_LEAST = 1e-5


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of a with rows of b, in double precision; the order of summation does not depend on the block."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def directions(dim: int, table: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, table])
    return rng.standard_normal((dim, DIRECTIONS)), rng.uniform(0, WIDTH, DIRECTIONS)


def cells(x: np.ndarray, table: int) -> np.ndarray:
    a, b = directions(x.shape[1], table)
    return np.floor((x @ a + b) / WIDTH).astype(np.int64)


def bucket(cell: np.ndarray, table: int) -> np.ndarray:
    """One number per row of cells; cells lie far within +-512."""
    out = np.full(len(cell), table, np.int64)
    for i in range(cell.shape[1]):
        out = out * 1024 + np.clip(cell[:, i], -511, 511) + 512
    return out


def _normal(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


def probes(x: np.ndarray, table: int, c: float, success: float = SUCCESS) -> Iterator[np.ndarray]:
    """Buckets of each unit query, in falling order of success, until their chances reach `success`."""
    a, b = directions(x.shape[1], table)
    at, spread = x @ a, np.sqrt(max(1 - c * c, 1e-6))
    for row in at:
        cell, chance = np.zeros((1, 0), np.int64), np.ones(1)
        for i in range(DIRECTIONS):
            mean = c * row[i]
            near = np.arange(int(np.floor((mean - 4.5 * spread + b[i]) / WIDTH)), int(np.floor((mean + 4.5 * spread + b[i]) / WIDTH)) + 1)
            edge = (np.append(near, near[-1] + 1) * WIDTH - b[i] - mean) / spread
            p = np.diff(_normal(edge))
            chance = np.outer(chance, p).ravel()
            cell = np.column_stack([np.repeat(cell, len(near), axis=0), np.tile(near, len(cell))])
            # Cells this unlikely are never reached: the rest holds nearly all of the chance.
            likely = chance > CELL_LEAST
            chance, cell = chance[likely], cell[likely]
        order = np.argsort(-chance, kind="stable")
        take = np.searchsorted(np.cumsum(chance[order]), success) + 1
        yield bucket(cell[order[:take]], table)


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, own: np.ndarray) -> pd.DataFrame:
    """The k best candidates of each query by exact cosine, ties to the smaller id; a candidate equal to `own` is left out.

    A product of unit matrices selects, with a margin above its rounding; the scores come from `cosine`.
    """
    uq, uc = q / np.linalg.norm(q, axis=1, keepdims=True), c / np.linalg.norm(c, axis=1, keepdims=True)
    out = []
    for i0 in range(0, len(q), 256):
        near = uq[i0 : i0 + 256] @ uc.T
        near[own[i0 : i0 + 256, None] == c_ids[None, :]] = -9
        for i, row in enumerate(near, i0):
            top = min(k, len(row))
            at = np.flatnonzero(row >= max(np.partition(row, len(row) - top)[len(row) - top] - 1e-9, -2))
            score = cosine(q[i], c[at])
            order = np.lexsort((c_ids[at], -score))[:k]
            out.append(pd.DataFrame({"qid": q_ids[i], "cid": c_ids[at[order]], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "cid": [], "score": []})


RESULT = "qid long, cid long, score double"


def _scan(members: DataFrame, asked: DataFrame, keys: list[str], k: int, tile: int) -> DataFrame:
    """Best k of every query in every group: `members` (keys, cid, vec), `asked` (keys, qid, qvec).

    Groups above `tile` rows on a side are cut into blocks, and each block of members meets each block of queries.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias(name))

    counts = stage(blocks(members, "mb").join(blocks(asked, "qb"), keys), "ann-groups")
    left = (
        members.join(counts, keys)
        .withColumn("mi", F.pmod(F.xxhash64("cid"), "mb").cast("int"))
        .withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .select(*keys, "mi", "qi", "cid", "vec")
    )
    right = (
        asked.join(counts, keys)
        .withColumn("qi", F.pmod(F.xxhash64("qid"), "qb").cast("int"))
        .withColumn("mi", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        .select(*keys, "mi", "qi", "qid", "qvec")
    )

    def work(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(q):
            return pd.DataFrame({"qid": np.array([], np.int64), "cid": np.array([], np.int64), "score": np.array([], float)})
        c, x = (np.stack(v.to_list()).astype(np.float64) for v in (m["vec"], q["qvec"]))
        ids = q["qid"].to_numpy()
        return _best(ids, x, m["cid"].to_numpy(), c, k, ids)

    on = [*keys, "mi", "qi"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(work, RESULT)


def fit_cosine(classes: DataFrame, queries: DataFrame, k: int) -> float:
    """The low quantile of the k-th neighbour's exact cosine over at most FIT_QUERIES queries (chosen by hash)."""
    sample = queries.orderBy(F.xxhash64("qid"), "qid").limit(FIT_QUERIES).select("qid", "qvec", "dim").collect()
    if not sample:
        return 0.5
    asked = {}
    for r in sample:
        asked.setdefault(r["dim"], []).append((r["qid"], r["qvec"]))

    def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                if dim in asked:
                    ids = np.array([i for i, _ in asked[dim]])
                    q = np.array([v for _, v in asked[dim]], np.float64)
                    yield _best(ids, q, part["cid"].to_numpy(), np.stack(part["vec"].to_list()).astype(np.float64), k, ids)

    found = classes.select("cid", "vec", "dim").mapInPandas(best_of, RESULT)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k)
    low = ranked.groupBy("qid").agg(F.min("score").alias("s")).agg(F.percentile_approx("s", FIT_QUANTILE, 1000)).first()[0]
    return float(min(max(low if low is not None else 0.5, 0.05), 0.999))


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    success: float = SUCCESS,
    tile: int = TILE,
) -> DataFrame:
    """The k nearest of every query among all other rows: query_id, rank (from 1), vec_id, score.

    Score is the cosine of the original vectors in double precision; ties go to the smaller vec_id. Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do rows without an id. A vector meets vectors of its own
    dimension only. Repeated rows count once; of an id with several vectors each is a candidate. With k or fewer other
    rows, all are returned. An empty table gives no rows; extra columns are ignored.
    """
    v = F.col(vec_col)
    kept = stage(
        rows.where(usable(v) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"), is_query.alias("asks"), F.size(v).alias("dim"))
        .withColumn("h", F.xxhash64("vec"))
        .withColumn("h2", F.hash("vec")),
        "ann-rows",
    )
    # One row per distinct vector, named by its least id; its k + 1 least ids are all that can be returned.
    low = Window.partitionBy("h", "h2", "dim").orderBy("id")
    few = kept.select("id", "h", "h2", "dim").distinct().withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1)
    ids = stage(few.groupBy("h", "h2", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)), "ann-ids")
    # Different vectors of one id stay apart.
    named = kept.join(ids.select("h", "h2", "dim", "cid"), ["h", "h2", "dim"])
    classes = stage(named.where("id = cid").select("cid", "vec", "dim", "h", "h2").dropDuplicates(["cid", "h", "h2"]), "ann-classes")
    queries = stage(
        named.where("asks").groupBy("h", "h2", "dim").agg(F.min("cid").alias("qid")).join(classes, ["h", "h2", "dim"]).select("qid", F.col("vec").alias("qvec"), "dim"),
        "ann-queries",
    )
    c = fit_cosine(classes, queries, k)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = _unit(part["vec"])
                for t in range(TABLES):
                    yield pd.DataFrame({"dim": dim, "bucket": bucket(cells(x, t), t), "cid": part["cid"].to_numpy(), "vec": part["vec"].to_numpy()})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = _unit(part["qvec"])
                for t in range(TABLES):
                    for i, found in enumerate(probes(x, t, c, success)):
                        yield pd.DataFrame({"dim": dim, "bucket": found, "qid": part["qid"].iloc[i], "qvec": [part["qvec"].iloc[i]] * len(found)})

    members = classes.select("cid", "vec", "dim").mapInPandas(index, "dim int, bucket long, cid long, vec array<double>")
    asked = queries.mapInPandas(visit, "dim int, bucket long, qid long, qvec array<double>")
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")

    def best(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

    merged = stage(best(_scan(members, asked, ["dim", "bucket"], k, tile)), "ann-found")
    # The exact way for queries with too few candidates.
    there = classes.groupBy("dim").agg(F.least(F.count(F.lit(1)) - 1, F.lit(k)).alias("due"))
    counts = merged.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = stage(queries.join(there, "dim").join(counts, "qid", "left").where("coalesce(n, 0) < due").select("dim", "qid", "qvec"), "ann-short")
    if not short.isEmpty():
        exact = _scan(classes.select("dim", "cid", "vec"), short, ["dim"], k, tile)
        merged = stage(merged.join(short.select("qid"), "qid", "left_anti").unionByName(best(exact)), "ann-merged")

    # From classes back to rows: each query row, each of its classes' least ids and its own class at cosine 1.
    asks = named.where("asks").select(F.col("id").alias("query_id"), F.col("cid").alias("qid"), "vec").dropDuplicates(["query_id", "qid"])
    own = asks.select("query_id", F.col("qid"), F.col("qid").alias("cid"), F.lit(1.0).alias("score"))
    norms = queries.select("qid", F.col("qvec"))
    self_score = norms.mapInPandas(
        lambda bs: (pd.DataFrame({"qid": b["qid"], "s": [float(cosine(v, v)) for v in map(np.asarray, b["qvec"])]}) for b in bs), "qid long, s double"
    )
    own = own.join(self_score, "qid").select("query_id", "cid", F.col("s").alias("score"))
    all_classes = asks.select("query_id", "qid").join(merged, "qid").select("query_id", "cid", "score").unionByName(own)
    members_of = ids.select("cid", "ids")
    out = all_classes.join(members_of, "cid").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
