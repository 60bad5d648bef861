"""Detection and masking of personal data, all in native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import exprs
from ..functions.families import col
from ..plans.kernel import ColumnStats, column_stats, rounded, table

SCHEMA = "column string, pii_type string, confidence_pct double"


def detected(s: ColumnStats) -> tuple[str, float] | None:
    """The most likely type of a column and how sure it is; None for a column without text."""
    if not s.texts:
        return None
    best = None
    for kind in exprs.PII_TYPES:
        pct = getattr(s, f"is_{kind}") / s.texts * 100
        if any(h in s.name.lower() for h in exprs.NAME_HINTS[kind]):
            pct = min(100.0, pct + 10)
        if best is None or pct > best[1]:
            best = (kind, pct)
    return best[0], rounded(best[1], 2)


def detect(df: DataFrame, min_confidence: float = 60, sample: int | None = None, stats: list[ColumnStats] | None = None) -> list[tuple[str, str, float]]:
    """(column, type, confidence) by confidence, then position. sample: look at about so many rows; None: at all."""
    if not 0 <= min_confidence <= 100:
        raise ValueError("min_confidence must be between 0 and 100")
    if stats is None:
        part = df
        if sample is not None and (n := df.count()) > sample:
            part = df.sample(False, min(1.0, sample / n), 42)
        stats = column_stats(part, pii=True, spread=False, counts=False)
    found = [(s.name, *d) for s in stats if (d := detected(s)) and d[1] >= min_confidence and d[1] > 0]
    return sorted(found, key=lambda r: -r[2])


def report(df: DataFrame, min_confidence: float = 60, sample: int | None = None) -> DataFrame:
    return table(df, detect(df, min_confidence, sample), SCHEMA)


def masked(df: DataFrame, min_confidence: float = 60, sample: int | None = None, mask_char: str = "*") -> DataFrame:
    kinds = {c: k for c, k, _ in detect(df, min_confidence, sample)}
    return df.select(*(exprs.mask(col(c), kinds[c], mask_char).alias(c) if c in kinds else col(c) for c in df.columns))
