"""The five report sections as projections of the statistics kernel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..plans.kernel import ColumnStats, rounded, share, table

SCHEMA = "position int, column string, dtype string, non_null_count long, missing_count long, missing_pct double, unique_count long, unique_pct double, memory_bytes long"
STATISTICS = (
    "column string, dtype string, count long, missing_count long, mean double, median double, std double, min double, q1 double, q2 double, q3 double, p95 double, p99 double, "
    "max double, range double, iqr double, skewness double, kurtosis double, mode string, mode_frequency long, geometric_mean double, harmonic_mean double, rms double, cv_pct double, mad double, z_outlier_count long"
)
QUALITY = "column string, duplicate_count long, missing_count long, zero_count long, outlier_count long, outlier_pct double"
ML = (
    "column string, dtype string, feature_type string, unique_count long, unique_pct double, missing_pct double, variance double, skewness double, outlier_pct double, "
    "cardinality string, encoding_suggestion string, scaling_suggestion string, transformation string, feature_status string"
)
ETL = (
    "column string, dtype string, rows long, missing_count long, missing_pct double, unique_count long, unique_pct double, duplicate_count long, duplicate_pct double, issue string, issue_count long, "
    "recommended_action string, etl_status string, negative_count long, zero_count long, outlier_count long, outlier_pct double, space_issue_count long, empty_string_count long, special_character_count long"
)


def schema(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    rows = [(i, s.name, s.dtype, s.non_null, s.missing, s.missing_pct, s.nunique, share(s.nunique, s.n), s.bytes) for i, s in enumerate(stats, 1)]
    return table(df, rows, SCHEMA)


def statistics(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    rows = []
    for s in stats:
        head = (s.name, s.dtype, s.non_null, s.missing)
        if not s.numeric or not s.q:
            rows.append((*head, *[None] * 14, s.mode, s.mode_frequency, *[None] * 6))
            continue
        r = lambda x: rounded(x, 4)
        q1, q2, q3, p95, p99 = s.q
        positive = s.min is not None and s.min > 0
        rows.append((
            *head, r(s.mean), r(q2), r(s.std), r(s.min), r(q1), r(q2), r(q3), r(p95), r(p99), r(s.max), r(s.max - s.min), r(q3 - q1), r(s.skew), r(s.kurt), s.mode, s.mode_frequency,
            r(math.exp(s.ln)) if positive and s.ln is not None else None, r(s.non_null / s.inv) if positive and s.inv else None, r(math.sqrt(s.sq)) if s.sq is not None else None,
            r(s.std / abs(s.mean) * 100) if s.mean and s.std is not None else None, r(s.mad), s.z_outliers,
        ))
    return table(df, rows, STATISTICS)


def quality(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    rows = [(s.name, s.duplicates, s.missing, *((s.zero, s.outliers, s.outlier_pct) if s.numeric else (None,) * 3)) for s in stats]
    return table(df, rows, QUALITY)


def ml(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    rows = []
    for s in stats:
        unique = s.nunique / s.n * 100 if s.n else 0.0
        head = (s.name, s.dtype, "Numeric" if s.numeric else "Categorical", s.nunique, rounded(unique, 2), s.missing_pct)
        status = "Possible ID" if unique > 95 else "Good"
        if s.numeric:
            skew = s.skew
            rows.append((*head, rounded(s.var, 4), rounded(skew, 4), s.outlier_pct, None, None, "RobustScaler" if s.outlier_pct > 5 else "StandardScaler", "Log Transform" if skew is not None and abs(skew) > 1 else "None", "Constant Feature" if s.var == 0 else status))
        else:
            kind = ("Low", "OneHot Encoding") if s.nunique <= 10 else ("Medium", "Target Encoding") if unique < 50 else ("High", "Hash Encoding")
            rows.append((*head, None, None, None, *kind, None, None, status))
    return table(df, rows, ML)


def etl(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    rows = []
    for s in stats:
        issues, count, action = [], 0, "No Action"
        if s.missing:
            issues, count, action = ["Missing Values"], s.missing, "Impute Values"
        if s.duplicates > 0:
            issues.append("Duplicate Values")
            count, action = count + s.duplicates, "Remove Duplicates"
        if s.numeric:
            issues += ["Negative Values"] * (s.negative > 0) + ["Outliers"] * (s.outliers > 0)
            tail = (s.negative, s.zero, s.outliers, s.outlier_pct, None, None, None)
        else:
            issues += ["Extra Spaces"] * (s.space > 0) + ["Empty String"] * (s.empty > 0)
            tail = (None, None, None, None, s.space, s.empty, s.special)
        rows.append((s.name, s.dtype, s.n, s.missing, s.missing_pct, s.nunique, share(s.nunique, s.n), s.duplicates, share(s.duplicates, s.n), ", ".join(issues) or "None", count, action, "Needs Cleaning" if issues else "Ready", *tail))
    return table(df, rows, ETL)


SECTIONS = {"schema": schema, "statistics": statistics, "quality": quality, "ml": ml, "etl": etl}
