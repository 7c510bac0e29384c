"""Computing an expensive expression exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns added by a one-row generator.

    Filters and projections above cannot be merged into a generator, so an expensive expression
    runs once per row however often, and in whatever lambda or filter, it is used later.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
