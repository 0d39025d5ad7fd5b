"""Writers of result tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import escape_formula
from .paths import remove, scratch


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), form: str = "parquet") -> None:
    out = df.write.partitionBy(*partition_by) if partition_by else df.write
    out.format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


@contextmanager
def clustered(df: DataFrame, buckets: int, by: Sequence[str] = ("series_id",), order: Sequence[str] = ("date",)) -> Iterator[DataFrame]:
    """df as a table in buckets of by, sorted by order, in the shared folder: windows, groups and joins over by need no exchange.

    For as long as the block lasts; what it makes must be written before. Files of one bucket
    come from one task, since rows are dealt by the buckets' own hash first.
    """
    spark = df.sparkSession
    name, path = f"clustered_{uuid.uuid4().hex}", scratch(spark, "clustered")
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*order).format("parquet").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]


def write_outcomes(df: DataFrame, path: str) -> None:
    """Whole rows as JSON, and their plain columns as CSV."""
    df.write.json(f"{path}/json")
    df.select(*scalar_columns(df)).write.option("header", "true").csv(f"{path}/csv")


def escape_formulas(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run get a quote before them."""
    return df.withColumns({c: escape_formula(c) for c, t in df.dtypes if t == "string"})
