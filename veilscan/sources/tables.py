"""Tables as a source: each row rendered to a CSV line and scanned like a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_as_text(table: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``(key, text)``: the chosen columns (default all) as one CSV line per row."""
    chosen = columns or table.columns
    return table.select(key, F.to_csv(F.struct(*chosen)).alias("text"))


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with every cell kept as a string.

    No type inference: it would rewrite numbers (lost leading zeros, blanks turning
    integers into floats) and so hide identifiers.
    """
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=False)
