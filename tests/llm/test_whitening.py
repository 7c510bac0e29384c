"""Whitening against a plain computation with exact integers and one covariance of all vectors."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(rows, fit="one"):
    """id to (x, deviation), and (n, values by falling size, trace, means, vectors)."""
    xs = {}
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            xs.setdefault(i, []).append(tuple(int(np.floor(64.0 * float(c))) + 1_000_000 for c in v))
    counts = Counter(x for own in xs.values() for x in own)
    weight = {x: 1 if fit == "one" else c for x, c in counts.items()}
    n = sum(weight.values())
    sums = [sum(w * x[d] for x, w in weight.items()) for d in range(len(next(iter(weight))))]
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in weight}
    centred = np.array([[float(a - s // n) - (s % n) / n for a, s in zip(x, sums)] for x in weight])
    w = np.array(list(weight.values()), float)
    cov = (centred * w[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return xs, deviation, n, values[::-1], vectors[:, ::-1], float(np.trace(cov)), dict(zip(weight, centred)), w


def check(got, rows, fit="one", components=16):
    xs, deviation, n, values, vectors, _, centred, _ = plain(rows, fit)
    assert Counter(r.id for r in got) == Counter({i: len(x) for i, x in xs.items()})
    for r in got:
        assert int(r.deviation) in {deviation[x] for x in xs[r.id]}
        best = min(np.abs(np.abs(np.array(r.whitened)) - np.abs(centred[x] @ vectors[:, :len(r.whitened)]
                   / np.sqrt(values[:len(r.whitened)]))).max(initial=0) for x in xs[r.id])
        assert best < 1e-6


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    xs, deviation, n, values, vectors, trace, centred, _ = plain(rows)
    got = defaultdict(dict)
    for r in queries.op12_whitening(spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(xs) and all(sorted(own) == list(range(1, 17)) for own in got.values())
    signs = None
    for i, own in got.items():
        x = xs[i][0]
        white = np.array([own[c].whitened for c in range(1, 17)])
        want = centred[x] @ vectors[:, :16] / np.sqrt(values[:16])
        if signs is None:
            signs = np.sign(white * want)
        assert np.abs(white - want * signs).max() < 1e-6
        for c, r in own.items():
            assert r.n == n and r.deviation == deviation[x] and r.identity_error <= 1e-4
            assert abs(r.explained - values[c - 1] / trace) <= 1e-6


@pytest.mark.parametrize("fit", ["one", "copies"])
def test_odd_rows_and_a_frequent_vector(spark, fit):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.normal(size=6) * [9, 5, 3, 2, 1, 0]]) for i in range(900)]
    rows += [(i, [0.25, -1.0, 2.0, 0.5, 0.125, 0.0]) for i in range(900, 1400)]      # a third of the rows
    rows += [(2000, None), (2001, [float("nan")] + [0.0] * 5), (2002, [None] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5),
             (5, [1.0] * 6), (5, [2.0] * 6), (None, [3.0] * 6), (None, None)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(3000, [1.0, 2.0], "x"), (3001, [], "x")],
                                  "vec_id long, embedding array<double>, copies string").repartition(7)
    got, model = whitening.whiten(frame, components=8, fit=fit)
    got = got.collect()
    assert {len(r.whitened) for r in got} == {6} if model["eigenvalues"][-1] > 0 and len(model["eigenvalues"]) == 6 else {5}
    check(got, rows, fit)
    assert model["identity_error"] < 1e-9 and abs(sum(model["explained"]) - 1) < 1e-9
    copies = Counter(r.copies for r in got)
    assert copies[500] == 500


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    got, model = whitening.whiten(spark.createDataFrame([], schema))
    assert got.collect() == [] and model["n"] == 0
    got, model = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert [(r.copies, int(r.deviation), r.whitened) for r in got.collect()] == [(2, 0, []), (2, 0, [])] and model["n"] == 1
    got, model = whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema))
    assert got.collect() == [] and model["explained"] == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i) * 2.0 ** 39, -float(i * i), 1.0]) for i in range(40)]
    got, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    _, deviation, *_ = plain(rows)
    assert sorted(int(r.deviation) for r in got.collect()) == sorted(deviation.values())
    with pytest.raises(Exception, match="too large to whiten"):
        whitening.whiten(spark.createDataFrame([(1, [2.0 ** 50])], "vec_id long, embedding array<double>"))


def test_no_row_is_gathered_by_a_frequent_vector(spark):
    """The shuffled side of the last join holds no vector of more than 1/HOT of the rows."""
    frame = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(
        F.when(F.col("id") < 1700, 1.0).otherwise(F.rand(1)), F.rand(2)).alias("embedding"))
    frame = frame.withColumn("embedding", F.when(F.col("vec_id") < 1700, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("embedding")))
    got, _ = whitening.whiten(frame)
    assert got.count() == 5000
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
