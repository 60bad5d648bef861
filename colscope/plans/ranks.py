"""Average ranks without a global sort in one task: counts per value, ranges between fixed bounds, prefix sums from range totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds_of(x: Column, n: int) -> Column:
    """An aggregate: values that cut ``x`` into n ranges with about as many rows each."""
    return F.percentile_approx(x, [i / n for i in range(1, n)], 10_000)


def _range_of(v: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are less than ``v``, by halving."""
    if not bounds:
        return F.lit(0)
    among = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(among, at + s - 1) < v), at + s).otherwise(at))


def ranked(counts: DataFrame, names: list[str], bounds: list[float]) -> DataFrame:
    """``counts``, a row for each value v, and for each column of counts ``c`` the average rank ``rank_c`` of v's rows among those it counts.

    The bounds are part of the plan: a value's range doesn't change if an executor is lost and its part is made again.
    """
    parts = counts.withColumn("_p", _range_of(F.col("v"), sorted({*bounds})))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = parts.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{c}") for c in names)).select("_p", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in names))
    own = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select("*", *(F.sum(c).over(own).alias(f"_s_{c}") for c in names)).join(F.broadcast(base), "_p")
    return run.select(*counts.columns, *((F.col(f"_b_{c}") + F.col(f"_s_{c}") - (F.col(c) - 1) / 2.0).alias(f"rank_{c}") for c in names))


def average_ranks(df: DataFrame, x: Column) -> DataFrame:
    """(v, rank) of the non-null values of ``x``: rank 1 is the smallest, ties share their mean."""
    rows = df.select(x.alias("v")).where("v is not null")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(bounds_of(F.col("v"), n)).first()[0] if n > 1 else None
    return ranked(rows.groupBy("v").agg(F.count("*").alias("c")), ["c"], bounds or []).select("v", F.col("rank_c").alias("rank"))
