"""Nearest neighbours by low-dimensional stable projections and a k-d tree.

A Gaussian (2-stable) projection to ``DIMS`` dimensions turns a distance ``d`` into ``d`` times the root of a chi-square
variable with ``DIMS`` degrees of freedom. A k-d tree over the projections of a bounded sample cuts the projected space
into leaves; every vector goes to the leaf that holds it. A query first searches a chunk of its own leaf, which bounds
the distance of its k-th neighbour. It then visits all leaves that the stopping test cannot rule out, and in each one
verifies its projected neighbours in growing order, by the true distance, until the test holds: the next projected
distance is beyond the ``CONFIDENCE`` quantile of the projected k-th distance found so far. A true neighbour is missed with
a probability of at most 1 - CONFIDENCE.

Leaves of more than ``CHUNK_ROWS`` vectors (copies of one vector cannot be cut apart) are searched in chunks, and
queries come in blocks of ``QUERY_BLOCK``, so the memory of a task is bounded. The tree is fitted on ``SAMPLE_ROWS``
vectors; every vector is indexed.

Vectors that are null or zero, that hold null or non-finite components, whose length differs from that of the sample's
first vector, or whose id is null take no part. Of rows that repeat a query's id one is searched. Ties go to the
smaller id. Without vectors, or without other candidates, the result is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DIMS = 8
CONFIDENCE = 0.98
SAMPLE_ROWS = 20_000
LEAF_ROWS = 2_048
CHUNK_ROWS = 8_192
QUERY_BLOCK = 20_000
VERIFIED_AT_ONCE = 64
SEED = 17
ROUNDING = 1e-9


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


@dataclass
class Tree:
    """A complete k-d tree: inner node i has children 2i + 1 and 2i + 2; leaves follow from left to right."""

    projection: np.ndarray
    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray  # boxes of the leaves
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int) -> Tree:
        projection = np.random.default_rng(SEED).standard_normal((sample.shape[1], DIMS))
        points = sample @ projection
        depth = max(0, math.ceil(math.log2(max(1, min(rows / LEAF_ROWS, len(sample) / 8)))))
        inner = 2 ** depth - 1
        dims, cuts = np.zeros(inner, np.int64), np.zeros(inner)
        low, high = np.full((inner + 2 ** depth, DIMS), -np.inf), np.full((inner + 2 ** depth, DIMS), np.inf)
        own = {0: points}
        for i in range(inner):
            p = own.pop(i)
            if len(p):
                dims[i] = np.argmax(p.max(axis=0) - p.min(axis=0))
                cuts[i] = np.median(p[:, dims[i]])
            left = p[:, dims[i]] <= cuts[i]
            for child, side in ((2 * i + 1, left), (2 * i + 2, ~left)):
                own[child], low[child], high[child] = p[side], low[i], high[i]
            high[2 * i + 1, dims[i]] = low[2 * i + 2, dims[i]] = cuts[i]
        return cls(projection, dims, cuts, low[inner:], high[inner:])

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf that holds each projected point."""
        at = np.zeros(len(points), np.int64)
        for _ in range((len(self.cuts) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dims[at]] > self.cuts[at])
        return at - len(self.cuts)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """The distance from a projected point to the box of every leaf."""
        return np.sqrt((np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1))


def verified(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, projected: np.ndarray, k: int,
             bound: float, quantile: float) -> list[tuple[int, float]]:
    """The k nearest of a chunk by (distance, id), verified in order of projected distance until the test holds."""
    order = np.argsort(projected, kind="stable")
    slack = ROUNDING * (1 + float(query @ query))  # equal vectors need not have equal projections to the last bit
    best: list[tuple[float, int]] = []
    for at in range(0, len(order), VERIFIED_AT_ONCE):
        if projected[order[at]] ** 2 > quantile * bound ** 2 + slack:
            break
        some = order[at:at + VERIFIED_AT_ONCE]
        some = some[ids[some] != own]
        true = np.sqrt(((vectors[some].astype(np.float64) - query) ** 2).sum(axis=1))
        best = sorted([*best, *zip(true.tolist(), ids[some].tolist())])[:k]
        if len(best) == k:
            bound = min(bound, best[-1][0])
    return [(i, d) for d, i in best]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every row where ``queries`` holds."""
    spark = vectors.sparkSession
    rows = (vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), queries.alias("asks")))
    rows = written(rows.withColumn("asks", F.coalesce("asks", F.lit(False))), "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not len(sample):
        return empty
    size = len(sample.iloc[0])
    rows = rows.where(F.size("v") == size)
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    tree = spark.sparkContext.broadcast(Tree.fit(np.stack([v for v in sample if len(v) == size]).astype(float), n))
    quantile = chi_square_quantile(confidence)
    blocks = asked // QUERY_BLOCK + 1

    def to_leaves(frames):
        for f in frames:
            if len(f):
                yield f.assign(leaf=tree.value.leaf(np.stack(f["v"].tolist()).astype(float) @ tree.value.projection))

    at = written(rows.mapInPandas(to_leaves, "id long, v array<float>, asks boolean, leaf long"), "leaves")
    chunks = at.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)).alias("chunks"))
    data = (at.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")))
            .select("leaf", "chunk", "id", "v"))
    block = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks))
    asks = (at.where("asks").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("v", "leaf")).alias("q"))
            .select("query_id", F.col("q.v").alias("q"), F.col("q.leaf").alias("leaf"), block.alias("block")))

    def search(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(asks):
            ids, v = data["id"].to_numpy(), np.stack(data["v"].tolist())
            p = v.astype(float) @ tree.value.projection
            for own, q, bound in zip(asks["query_id"], asks["q"], asks["bound"]):
                q = np.asarray(q, dtype=np.float64)
                near = np.sqrt(((p - q @ tree.value.projection) ** 2).sum(axis=1))
                found += [(own, i, d) for i, d in verified(q, own, v, ids, near, k, bound, quantile)]
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype(
            {"query_id": "int64", "id": "int64", "score": "float64"})

    def searched(data: DataFrame, asks: DataFrame) -> DataFrame:
        spread = data.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        key = ["leaf", "chunk", "block"]
        return spread.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(
            search, "query_id long, id long, score double")

    first = searched(data.where("chunk = 0"), asks.withColumn("chunk", F.lit(0).cast("long"))
                     .withColumn("bound", F.lit(float("inf"))))
    bounds = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    asks = asks.drop("leaf").join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf"))))

    def visits(frames):
        for f in frames:
            out = []
            for q, bound in zip(f["q"], f["bound"]):
                q = np.asarray(q, dtype=float)
                far = tree.value.distances(q @ tree.value.projection)
                out.append(np.nonzero(far ** 2 <= quantile * bound ** 2 + ROUNDING * (1 + float(q @ q)))[0])
            yield f.assign(leaves=out)

    visit = (asks.mapInPandas(visits, "query_id long, q array<float>, block long, bound double, leaves array<long>")
             .withColumn("leaf", F.explode("leaves")).drop("leaves").join(chunks, "leaf")
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks"))
    ranked = searched(data, visit).withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
