"""Weighted quality scores, per column and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.kernel import ColumnStats, rounded, share, table

DIMENSIONS = ("missing", "duplicates", "outliers", "dtypes", "invalid")
DEFAULT_WEIGHTS = dict.fromkeys(DIMENSIONS, 20.0)
BY_COLUMN = "column string, dtype string, missing_score double, duplicate_score double, outlier_score double, data_type_score double, invalid_score double, quality_score double"
OVERALL = ("Overall Quality Score", "Missing Score", "Duplicate Score", "Outlier Score", "Data Type Score", "Invalid Values Score")


def weights_of(weights: dict[str, float] | None) -> dict[str, float]:
    unknown = set(weights or {}) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}; known: {', '.join(DIMENSIONS)}")
    w = DEFAULT_WEIGHTS | (weights or {})
    total = sum(w.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    return {k: v / total * 100 for k, v in w.items()}


def scores(s: ColumnStats) -> tuple[float, ...]:
    """Scores in the order of DIMENSIONS, each rounded to two digits before it goes on."""
    left = lambda pct: rounded(100 - pct, 2)
    base = (left(s.missing_pct), left(share(s.duplicates, s.n)))
    if s.numeric:
        bad = left(share(s.inf, s.n))
        return (*base, left(s.outlier_pct), bad, bad)
    part = s.numeric_like / s.non_null if s.non_null else 0.0
    types = max(0.0, left(rounded(part * 100, 2) if part > 0.8 else 0.0))
    return (*base, 100.0, types, left(min(share(s.space + s.empty + s.special, s.n), 100.0)))


def weighted(parts: tuple[float, ...], w: dict[str, float]) -> float:
    return rounded(sum(p * w[k] for p, k in zip(parts, DIMENSIONS, strict=True)) / 100, 2)


def by_column(df: DataFrame, stats: list[ColumnStats], w: dict[str, float]) -> DataFrame:
    return table(df, [(s.name, s.dtype, *(p := scores(s)), weighted(p, w)) for s in stats], BY_COLUMN)


def overall(df: DataFrame, stats: list[ColumnStats], w: dict[str, float], n: int, duplicate_rows: int) -> DataFrame:
    parts = [rounded(sum(c) / len(stats), 2) for c in zip(*map(scores, stats), strict=True)]
    parts[1] = rounded(100 - share(duplicate_rows, n), 2)
    total = weighted(tuple(parts), w)
    return table(df, list(zip(OVERALL, [total, *parts], strict=True)), "metric string, score double")
