"""Type families of columns, static projections and null normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_TYPES = ("all", "numeric", "categorical")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(field: T.StructField) -> str:
    """numeric, string, boolean, timestamp, date or other."""
    t = field.dataType
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "date" if isinstance(t, T.DateType) else "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f) for f in df.schema.fields}


def require_frame(df: object, name: str = "df") -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a pyspark DataFrame, got {type(df).__name__}")


def choice(value: str, allowed: tuple[str, ...], name: str) -> str:
    v = str(value).lower()
    if v not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
    return v


def project(df: DataFrame, column_type: str = "all") -> DataFrame:
    """Columns of a family, decided from the schema alone: no job."""
    kind = choice(column_type, COLUMN_TYPES, "column_type")
    want = {"all": None, "numeric": {"numeric"}, "categorical": {"string", "boolean"}}[kind]
    names = [c for c, f in families(df).items() if want is None or f in want]
    if not names:
        raise ValueError(f"there are no {kind} columns")
    return df.select(*(col(c) for c in names))


def value(name: str, fam: str, field: T.StructField) -> Column:
    """NaN counts as missing; numbers become doubles."""
    c = col(name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double") if fam == "numeric" else c


def groupable(name: str, fam: str, field: T.StructField) -> Column:
    """A form of the column that can be grouped and compared, NaN as null, maps as JSON."""
    c = col(name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return F.to_json(c) if fam == "other" and isinstance(field.dataType, (T.MapType, T.VariantType)) else c


def as_text(name: str, fam: str, field: T.StructField) -> Column:
    c = col(name)
    if fam == "other" and isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def logical_bytes(name: str, field: T.StructField) -> Column:
    """Sum of the values' logical bytes: fixed widths, or the UTF-8 length of text."""
    width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    t, c = field.dataType, col(name)
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.sum(F.size(c) * width.get(type(t.elementType), 8)), F.lit(0)).cast("long")
    if isinstance(t, (T.StructType, T.MapType)):
        return F.coalesce(F.sum(F.octet_length(F.to_json(c))), F.lit(0)).cast("long")
    return (F.count(c) * width.get(type(t), 8)).cast("long")
