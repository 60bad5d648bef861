"""Exact percentiles and average ranks against brute force, with many ties, infinities and intervals that need narrowing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.plans.quantiles import exact_percentiles
from colscope.plans.ranks import average_ranks

WANTED = (0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@pytest.fixture(scope="module")
def numbers(spark):
    r = np.random.default_rng(7)
    n = 30_000
    cols = {
        "wide": r.normal(size=n) * 1e6, "ties": r.integers(0, 3, n).astype(float), "one": np.full(n, 4.5), "skew": np.exp(r.normal(size=n) * 4),
        "ends": np.where(r.random(n) < 0.01, -np.inf, r.random(n)), "half": np.where(r.random(n) < 0.6, 0.0, r.random(n)),
    }
    rows = [tuple(float(v) for v in row) for row in zip(*cols.values(), strict=True)]
    rows += [(None,) * len(cols)] * 5
    return cols, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7).cache()


@pytest.mark.parametrize("held", [5, 20_000])
def test_percentiles(numbers, held):
    cols, df = numbers
    got = exact_percentiles(df, [F.col(c) for c in cols], [len(v) for v in cols.values()], WANTED, held)
    for (name, v), ours in zip(cols.items(), got, strict=True):
        v = np.sort(v)
        for p, x in zip(WANTED, ours, strict=True):
            pos = p * (len(v) - 1)
            a, b = v[int(np.floor(pos))], v[int(np.ceil(pos))]
            want = a if a == b else a + (pos - np.floor(pos)) * (b - a)
            assert x == pytest.approx(want, rel=1e-9), (name, p)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_percentiles_of_few(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
    (got,) = exact_percentiles(df, [F.col("x")], [n], (0.25, 0.5))
    assert got == ([float(np.quantile(range(n), p)) for p in (0.25, 0.5)] if n else None)


def test_ranks(numbers):
    _, df = numbers
    for c in ("wide", "ties", "one", "half"):
        rows = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).collect())
        want, i = {}, 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j] == rows[i]:
                j += 1
            want[rows[i]] = (i + 1 + j) / 2
            i = j
        assert {r.v: r["rank"] for r in average_ranks(df, F.col(c)).collect()} == want
