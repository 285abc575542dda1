"""Columns that are costly to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each made once for a row however often it is used later.

    The optimizer copies an expression to where it is used, filters included; it does
    not look through a generator.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("__made")).select(*kept, "__made.*")
