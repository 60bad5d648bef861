"""The statistics kernel: every report is a projection of what three passes gather.

Pass A is one aggregate over all columns; percentiles take three small ones (plans/quantiles.py); pass B needs A's means and the quartiles; pass F counts values column by
column. What comes to the driver is one row per column. Percentiles and distinct counts are exact, or approximate on request.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..functions.families import as_text, col, families, groupable, logical_bytes, value
from .quantiles import exact_percentiles

CHUNK = 30  # columns per aggregate of few cells
EACH, AT_ONCE = 2, 4  # columns per aggregate of pass A: beyond, the generated method is too long for the JIT; and jobs at a time
QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def rounded(x: float | None, digits: int) -> float | None:
    """Half away from zero on the shortest decimal form, as Spark rounds doubles; no negative zero."""
    if x is None or math.isnan(x):
        return None
    if math.isinf(x):
        return x
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0


def share(part: float, whole: float) -> float:
    """A percentage with two digits; 0 of nothing."""
    return rounded(part * 100 / whole, 2) if whole else 0.0


@dataclass
class ColumnStats:
    name: str
    family: str
    dtype: str
    n: int = 0
    values: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, key: str) -> Any:
        try:
            return self.__dict__["values"][key]
        except KeyError:
            raise AttributeError(key) from None

    @property
    def numeric(self) -> bool:
        return self.family == "numeric"

    @property
    def missing(self) -> int:
        return self.n - self.non_null

    @property
    def missing_pct(self) -> float:
        return share(self.missing, self.n)

    @property
    def duplicates(self) -> int:
        """Rows beyond the first of each value; missing counts as one value."""
        return self.n - self.nunique - (1 if self.missing else 0)

    @property
    def skew(self) -> float | None:
        """Adjusted for bias; 0 for a constant."""
        n, g = self.non_null, self.g1
        if n < 3:
            return None
        if g is None:
            return 0.0 if self.var == 0 else None
        return g * math.sqrt(n * (n - 1)) / (n - 2)

    @property
    def kurt(self) -> float | None:
        n, g = self.non_null, self.g2
        if n < 4:
            return None
        if g is None:
            return 0.0 if self.var == 0 else None
        return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)

    @property
    def outlier_pct(self) -> float:
        return share(self.outliers, self.n)


def _clean(v: Any) -> Any:
    return None if isinstance(v, float) and math.isnan(v) else v


def _run(df: DataFrame, wanted: list[dict[str, Column]], each: int = CHUNK) -> list[dict[str, Any]]:
    """One aggregate per ``each`` columns, which reads only these, AT_ONCE jobs at a time."""

    def one(k: int) -> list[dict[str, Any]]:
        part = wanted[k : k + each]
        cells = [c.alias(f"{i}_{n}") for i, e in enumerate(part) for n, c in e.items()]
        row = df.agg(F.count("*").alias("n"), *cells).first().asDict()
        return [{"n": row["n"], **{n: _clean(row[f"{i}_{n}"]) for n in e}} for i, e in enumerate(part)]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [r for part in pool.map(one, range(0, len(wanted), each)) for r in part]


def _first(f: T.StructField, fam: str, pii: bool, approx: bool) -> dict[str, Column]:
    return _measures(f, fam, approx) | (_personal(f, fam) if pii else {})


def _measures(f: T.StructField, fam: str, approx: bool) -> dict[str, Column]:
    c = groupable(f.name, fam, f)
    out = {"non_null": F.count(c), "bytes": logical_bytes(f.name, f)}
    if approx:
        out["nunique"] = F.approx_count_distinct(c)
    if fam == "numeric":
        x = value(f.name, fam, f)
        finite = F.when(F.abs(x) != float("inf"), x)
        out |= {
            "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "var": F.var_samp(x), "g1": F.skewness(x), "g2": F.kurtosis(x),
            "sq": F.avg(x * x), "ln": F.avg(F.when(finite > 0, F.ln(finite))), "inv": F.sum(F.when(x > 0, 1 / x)),
            "zero": F.count_if(x == 0), "negative": F.count_if(x < 0), "inf": F.count_if(F.abs(x) == float("inf")),
        }
        if approx:
            out["q"] = F.percentile_approx(x, list(QUANTILES), 10_000)
    else:
        t = as_text(f.name, fam, f)
        if fam in ("boolean", "date", "timestamp"):  # letters alone, or digits with signs between them
            zero = F.count_if(F.lit(False))
            return out | {"space": zero, "empty": zero, "numeric_like": zero, "special": zero if fam == "boolean" else F.count(c)}
        out |= {"space": F.count_if(exprs.has_outer_space(t)), "empty": F.count_if(t == ""), "special": F.count_if(exprs.has_special(t)), "numeric_like": F.count_if(exprs.is_numeric_like(t))}
    return out


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _personal(f: T.StructField, fam: str) -> dict[str, Column]:
    """How much text a column has and how much of it looks like each PII type. Fractions, times and truth values never do."""
    if fam in ("string", "other") or (isinstance(f.dataType, T.DecimalType) and not f.dataType.scale):
        s = F.col("`_cs_stripped_" + f.name.replace("`", "``") + "`")
        return {"texts": F.count(s), **{f"is_{k}": F.count_if(m) for k, m in exprs.matches(s).items()}}
    if isinstance(f.dataType, _INTEGERS):
        return {"texts": F.count(col(f.name)), **{f"is_{k}": F.count_if(m) for k, m in exprs.matches_integer(col(f.name).cast("long")).items()}}
    return {"texts": F.count(col(f.name)), **{f"is_{k}": F.count_if(F.lit(False)) for k in exprs.PII_TYPES}}


def _with_stripped(df: DataFrame) -> DataFrame:
    """Each text column without outer white space beside it, made once for all predicates that read it; null where nothing is left."""
    fams, extra = families(df), []
    for f in df.schema.fields:
        if fams[f.name] in ("string", "other") or isinstance(f.dataType, T.DecimalType):
            s = exprs.strip(as_text(f.name, fams[f.name], f))
            extra.append(F.when(s != "", s).alias(f"_cs_stripped_{f.name}"))
    return df.select("*", *extra)


def frequencies(df: DataFrame, names: list[str]) -> dict[str, dict[str, Any]]:
    """nunique, mode (smallest of the most frequent, as text) and its frequency, by one grouping per column.

    A grouping reads only its column and combines before it shuffles; all columns' results come in one job.
    """
    fams, fields = families(df), {f.name: f for f in df.schema.fields}
    out: dict[str, dict[str, Any]] = {}
    for k in range(0, len(names), CHUNK):
        parts = None
        for i, name in enumerate(names[k : k + CHUNK]):
            c = groupable(name, fams[name], fields[name])
            text = c.cast("string") if fams[name] != "other" else as_text(name, fams[name], fields[name])
            counts = df.select(c.alias("v"), text.alias("t")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"), F.first("t").alias("t"))
            one = counts.agg(F.lit(k + i).alias("i"), F.count("*").alias("nunique"), F.max("c").alias("mode_frequency"), F.min_by("t", F.struct(-F.col("c"), F.col("v"))).alias("mode"))
            parts = one if parts is None else parts.unionByName(one)
        for r in parts.collect():
            out[names[r.i]] = {"nunique": r.nunique, "mode": r.mode, "mode_frequency": r.mode_frequency or 0}
    return out


def column_stats(df: DataFrame, pii: bool = False, approx: bool = False, spread: bool = True, counts: bool = True) -> list[ColumnStats]:
    """Statistics of all columns, in their order. spread: percentiles and pass B; counts: pass F (always exact unless ``approx``)."""
    fams = families(df)
    out = []
    for f, got in zip(df.schema.fields, _run(_with_stripped(df) if pii else df, [_first(f, fams[f.name], pii, approx) for f in df.schema.fields], EACH), strict=True):
        if "var" in got:
            got["std"] = None if got["var"] is None else math.sqrt(got["var"])
        out.append(ColumnStats(f.name, fams[f.name], f.dataType.simpleString(), got.pop("n"), got))
    fields = {f.name: f for f in df.schema.fields}
    if spread and not approx:
        nums = [s for s in out if s.numeric]
        for s, q in zip(nums, exact_percentiles(df, [value(s.name, s.family, fields[s.name]) for s in nums], [s.non_null for s in nums], QUANTILES), strict=True):
            s.values["q"] = q
    if spread and (nums := [s for s in out if s.numeric and s.q]):
        wanted = []
        for s in nums:
            x, (q1, _, q3, *_) = value(s.name, s.family, fields[s.name]), s.q
            iqr = q3 - q1
            e = {"outliers": F.count_if((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr))}
            if s.mean is not None:
                e["mad"] = F.avg(F.abs(x - s.mean))
            if s.std:
                e["z_outliers"] = F.count_if(F.abs((x - s.mean) / s.std) > 3)
            wanted.append(e)
        for s, got in zip(nums, _run(df, wanted), strict=True):
            got.pop("n")
            s.values.update(got)
    for s in out:
        if s.numeric:
            s.values.setdefault("q", None)
        s.values.setdefault("outliers", 0)
        s.values.setdefault("mad", None)
        s.values.setdefault("z_outliers", 0)
    if counts:
        for name, got in frequencies(df, [s.name for s in out]).items():
            next(s for s in out if s.name == name).values.update(got if not approx else {k: v for k, v in got.items() if k != "nunique"})
    return out


def duplicate_rows(df: DataFrame) -> tuple[int, int]:
    """(rows, rows beyond the first of each kind); nulls and NaN are equal to themselves."""
    fams = families(df)
    keys = df.select(*(groupable(f.name, fams[f.name], f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
    r = keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    return r.n, r.n - r.k


def table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A report, one row per column, pair or alert."""
    return df.sparkSession.createDataFrame(rows, schema)


__all__ = ["ColumnStats", "col", "column_stats", "duplicate_rows", "frequencies", "rounded", "share", "table"]
