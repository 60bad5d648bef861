"""Semantic type of each column: a grouping by its values, of which the rest is measured, then a decision list on the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.families import families, groupable
from ..plans.kernel import CHUNK

# Words in a column's name, and what counts as yes and no.
ID_HINTS = ("id", "_id", "code", "uuid", "guid", "key")
LATITUDE_HINTS = ("lat", "latitude")
LONGITUDE_HINTS = ("lon", "lng", "longitude")
PERCENT_HINTS = ("pct", "percent", "percentage", "rate", "ratio")
CURRENCY_HINTS = ("price", "salary", "cost", "amount", "revenue", "income", "fee", "wage", "expense", "value", "payment", "budget")
YES_NO = ("true", "yes", "y", "1", "false", "no", "n", "0")

ID_UNIQUENESS = 0.95


def _hint(name: str, words: tuple[str, ...]) -> bool:
    return any(w in name.lower() for w in words)


_CELLS = ("n", "u", "yes_no", "lat", "lon", "texts", "email", "phone", "dates", "length")


def _measure(v: Column, k: Column, fam: str) -> dict[str, Column]:
    """Of distinct non-null values ``v`` that occur ``k`` times."""
    rows = lambda c: F.coalesce(F.sum(F.when(c, k)), F.lit(0))
    out = {"n": F.coalesce(F.sum(k), F.lit(0)), "u": F.count("*")}
    if fam in ("string", "numeric", "boolean"):
        t = F.lower(exprs.strip(v.cast("string")))
        if fam == "numeric":
            t = F.regexp_replace(t, r"\.0\z", "")
        out["yes_no"] = rows(t.isin(*YES_NO))
    if fam == "numeric":
        x = v.cast("double")
        out |= {"lat": rows(x.between(-90, 90)), "lon": rows(x.between(-180, 180))}
    if fam == "string":
        s = exprs.strip(v)
        s = F.when(s != "", s)
        out |= {"texts": rows(s.isNotNull()), "email": rows(s.rlike(exprs.EMAIL)), "phone": rows(exprs.is_phone(s)), "dates": rows(exprs.parses_as_date(s)), "length": F.sum(F.length(s) * k) / F.sum(F.when(s.isNotNull(), k))}
    return out


def decide(name: str, fam: str, m: dict, id_uniqueness: float = ID_UNIQUENESS) -> str:
    n, u = m["n"], m["u"]
    if not n:
        return "categorical"
    if u == 1:
        return "constant"
    if fam == "boolean" or (u <= 2 and m.get("yes_no") == n):
        return "boolean"
    if fam == "timestamp":
        return "datetime"
    if fam == "date":
        return "date"
    ratio = u / n
    if fam == "numeric":
        rules = (
            (_hint(name, ID_HINTS) and ratio >= id_uniqueness, "id"),
            (_hint(name, LATITUDE_HINTS) and m["lat"] > 0.99 * n, "latitude"),
            (_hint(name, LONGITUDE_HINTS) and m["lon"] > 0.99 * n, "longitude"),
            (_hint(name, PERCENT_HINTS), "percentage"),
            (_hint(name, CURRENCY_HINTS), "currency"),
        )
        return next((label for hit, label in rules if hit), "numeric")
    if fam != "string" or not m["texts"]:
        return "categorical"
    t = m["texts"]
    rules = (
        (m["email"] > 0.9 * t, "email"),
        (m["phone"] > 0.9 * t, "phone"),
        (m["dates"] >= 0.9 * t, "date"),
        (ratio >= id_uniqueness and _hint(name, ID_HINTS), "id"),
        (ratio > 0.5 and m["length"] > 25, "text"),
        (ratio >= id_uniqueness, "id"),
    )
    return next((label for hit, label in rules if hit), "categorical")


def measures(df: DataFrame) -> dict[str, dict]:
    """Per column its non-null values (n), distinct ones (u) and what decide() looks at. A grouping per column, all in one job."""
    fams, out = families(df), {}
    fields = df.schema.fields
    for k in range(0, len(fields), CHUNK):
        parts = None
        for i, f in enumerate(fields[k : k + CHUNK]):
            counts = df.select(groupable(f.name, fams[f.name], f).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
            m = _measure(F.col("v"), F.col("k"), fams[f.name])
            one = counts.agg(F.lit(k + i).alias("i"), *(m.get(key, F.lit(None)).cast("double" if key == "length" else "long").alias(key) for key in _CELLS))
            parts = one if parts is None else parts.unionByName(one)
        for r in parts.collect():
            out[fields[r.i].name] = {key: r[key] for key in _CELLS}
    return out


def semantic_types(df: DataFrame, id_uniqueness: float = ID_UNIQUENESS, found: dict[str, dict] | None = None) -> dict[str, str]:
    """found: measures() of the frame, where they are known."""
    fams, found = families(df), measures(df) if found is None else found
    return {c: decide(c, fams[c], found[c], id_uniqueness) for c in df.columns}


def detect_semantic_type(df: DataFrame, name: str) -> str:
    return semantic_types(df.select("`" + name.replace("`", "``") + "`"))[name]


def semantic_type_counts(df: DataFrame) -> dict[str, int]:
    return dict(Counter(semantic_types(df).values()))
