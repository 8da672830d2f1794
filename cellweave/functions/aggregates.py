"""Aggregations by name, and those of users: a function of a pandas Series to one value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_all() -> Column:
    return F.count(F.lit(1))


def count_present(column: str) -> Column:
    return F.count(column)


def count_unique(column: str) -> Column:
    return F.count_distinct(column)


def first_by(column: str, order: str) -> Column:
    """The value of the row that comes first in `order`."""
    return F.min_by(column, order)


def custom(function: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A user's aggregation over whole groups, run by Arrow. Groups pass through one task each, so it suits small groups."""
    import pandas as pd

    def run(values):
        return function(values)

    run.__annotations__ = {"values": pd.Series, "return": object}
    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def group(df: DataFrame, keys: list[str], aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Keys, then aggregates; a count where none is given."""
    made = aggregates or {"count": count_all()}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in made.items()])
