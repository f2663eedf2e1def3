"""Compute a column once, whatever is filtered or exploded above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot drag down the plan.

    Catalyst moves a filter below a projection by substituting the column's expression,
    and exploding an array adds such a filter by itself.  For an expensive expression
    that means evaluating it again, many times when it builds on others of its kind.
    Unnesting a one-element array yields the same row and stops the substitution, while
    filters on the other columns still reach the scan.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    unnested = df.select(*kept, F.explode(F.array(fields)).alias("_pin"))
    return unnested.select(*kept, *[F.col("_pin")[name].alias(name) for name in columns])
