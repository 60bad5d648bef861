"""CSV source with an exact row count and, above a size, a stable Bernoulli sample."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, sample_size: int | None = 100_000, random_state: int | None = None, columns: list[str] | None = None, schema: str | None = None, **options) -> tuple[DataFrame, int, bool]:
    """(table, rows in the source, whether it is a sample). Options go to Spark's reader (sep, header, dateFormat, ...).

    The sample keeps about ``sample_size`` rows; its seed is drawn here if none is given, so every pass sees the same rows.
    """
    options = {"header": True, **({} if schema else {"inferSchema": True}), **options}
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if columns is not None:
        df = df.select(*("`" + c.replace("`", "``") + "`" for c in columns))
    total = df.count()
    if sample_size is None or total <= sample_size:
        return df, total, False
    seed = random.randrange(2**31) if random_state is None else random_state
    return df.sample(False, sample_size / total, seed), total, True
