"""Whitening of embeddings by the covariance of their distinct integer vectors.

Every entry c becomes the integer ``x = floor(64 c) + 1000000``. Rows with equal x are grouped first (combined before the
shuffle, so that a vector that a third of the rows share is one row from then on). The fit weighs each distinct vector
by one or by its number of copies. Sums are exact integers; the weighted covariance is summed from one centred matrix
product for each task, added up cell by cell, and only its d x d cells reach the driver, where they are decomposed. Each
distinct vector is whitened once and joined back to its rows: those that hold more than 1/``HOT`` of all rows (fewer than
``HOT`` of them, whatever the table) by a broadcast, the rest by a shuffle in which no vector is frequent.

Rows take no part if their vector is null, holds null or non-finite entries or has another length than most vectors
(ties: the longest). Entries of 2**46 and more are refused with an error. A component without variance (an eigenvalue of
at most d x 2**-52 of the largest) cannot be whitened and is left out: a table with one distinct vector gives rows with
no components, an empty table gives none. Null, equal and repeated ids are kept row by row. Only the id and the
vector are read. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 46
HOT = 1_000


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    def whole(c: Column) -> Column:
        big = F.abs(c) >= LARGEST
        return F.when(big, F.raise_error(F.lit("an entry is too large to whiten")).cast("long")).otherwise(
            F.floor(F.lit(float(SCALE)) * c) + SHIFT)

    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & good)
    usual = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("v") == (usual.d if usual else 0)).select("id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _sums(rows: DataFrame, weight: Column) -> tuple[int, list[int]]:
    """(n, S): the weight of all vectors and the exact weighted sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weights = 0, 0
        for batch in batches:
            x, w = _matrix(batch.column(0), batch.num_rows), batch.column(1).to_numpy()
            bound = int(np.abs(x).max(initial=0)) * int(w.sum())
            kind = np.int64 if bound < 1 << 62 else object
            total = total + (x.astype(kind) * w.astype(kind)[:, None]).sum(axis=0).astype(object)
            weights += int(w.sum())
        if weights:
            cells = [Decimal(int(v)) for v in (weights, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(cells) - 1), pa.int32()),
                                              pa.array(cells, pa.decimal128(38, 0))], ["i", "v"])

    parts = rows.select("x", weight.cast("long").alias("w")).mapInArrow(run, "i int, v decimal(38,0)")
    cells = {r.i: int(r.v) for r in parts.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return cells.get(-1, 0), [cells[i] for i in range(len(cells) - 1)]


def covariance(rows: DataFrame, column: str, weight: Column, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The weighted covariance of a column of arrays whose mean is ``base + rest`` (whole part first, so that integers
    are centred without loss), with divisor ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = None
        for batch in batches:
            y = (_matrix(batch.column(0), batch.num_rows) - base) - rest
            own = (y * batch.column(1).to_numpy()[:, None].astype(float)).T @ y
            product = own if product is None else product + own
        if product is not None:
            i, j = np.triu_indices(len(product))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(product[i, j])], ["i", "j", "v"])

    parts = rows.select(column, weight.cast("long").alias("w")).mapInArrow(run, "i int, j int, v double")
    out = np.zeros((len(base), len(base)))
    for cell in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[cell.i, cell.j] = out[cell.j, cell.i] = cell.v / n
    return out


def _weighted_mean(rows: DataFrame, column: str, weight: Column, n: int, size: int) -> np.ndarray:
    cells = rows.select(F.posexplode(column).alias("i", "v"), weight.alias("w")).groupBy("i").agg(
        F.sum(F.col("v") * F.col("w")).alias("v")).collect()
    out = np.zeros(size)
    for cell in cells:
        out[cell.i] = cell.v / n
    return out


def whiten(rows: DataFrame, components: int = 16, fit: str = "one", id_col: str = "vec_id",
           vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(id, copies, deviation, whitened) of every row that takes part, and the model.

    ``deviation`` is the exact sum of ``(n x - S)**2`` as decimal(38, 0); ``whitened`` holds the components by falling
    eigenvalue. ``fit``: ``one`` weighs distinct vectors alike, ``copies`` by their rows. The model holds ``n``, ``sums``,
    ``eigenvalues``, ``vectors``, ``explained`` and ``identity_error``.
    """
    if fit not in ("one", "copies"):
        raise ValueError(f"fit by {fit!r}")
    spark = rows.sparkSession
    own = integers(rows, id_col, vector_col)
    distinct = written(own.groupBy("x").agg(F.count("*").alias("copies")), "distinct")
    weight = F.lit(1).cast("long") if fit == "one" else F.col("copies")
    n, sums = _sums(distinct, weight)
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - s // n) for s in sums])
    cov = covariance(distinct, "x", weight, n, base, rest)
    values, vectors = np.linalg.eigh(cov) if len(cov) else (np.zeros(0), cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = int((values > len(values) * 2.0 ** -52 * max(values.max(initial=0), 0)).sum())
    kept = min(components, used)
    vectors = vectors[:, :kept]
    if kept:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    project = vectors / np.sqrt(values[:kept])
    skew = np.array([s % n for s in sums], dtype=object)  # n x - S = n (x - base) - S mod n
    limit = (1 << 30) // max(1, int(np.sqrt(len(base))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            white = ((x - base) - rest) @ project
            kind = np.int64 if (int(np.abs(x - base).max(initial=0)) + 1) * n < limit else object
            away = (x - base).astype(kind) * n - skew.astype(kind)
            deviation = (away * away).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept), pa.array(white.ravel()))],
                ["x", "copies", "deviation", "whitened"])

    white = written(distinct.mapInArrow(
        run, "x array<long>, copies long, deviation decimal(38,0), whitened array<double>"), "whitened")
    mean = _weighted_mean(white, "whitened", weight, n, kept)
    off = covariance(white, "whitened", weight, n, np.zeros(kept), mean) - np.eye(kept)
    trace = float(np.trace(cov))
    model = {"n": n, "sums": sums, "eigenvalues": values[:kept], "vectors": vectors,
             "explained": [float(e / trace) for e in values[:kept]],
             "identity_error": float(np.abs(off).max(initial=0))}
    return _joined(own, white), model


def _joined(own: DataFrame, white: DataFrame) -> DataFrame:
    """The rows with what belongs to their vector."""
    total = white.agg(F.sum("copies").alias("rows")).first().rows or 0
    frequent = F.col("copies") * HOT > total
    hot = white.where(frequent).select("x", F.struct("copies", "deviation", "whitened").alias("own"))
    seen = own.join(F.broadcast(hot), "x", "left")
    usual = seen.where("own is null").select("id", "x").join(white.where(~frequent), "x").drop("x")
    return seen.where("own is not null").select("id", "own.*").unionByName(usual)
