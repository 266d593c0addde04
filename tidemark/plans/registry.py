"""Queries by survey id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers the decorated (spark, sf_dir) function, with the SQL that gives the same rows."""

        def take(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return take


def rounded(df: DataFrame, places: int = 6, but: Sequence[str] = ()) -> DataFrame:
    """Doubles to a number of places, so that sums taken in another order give the same value."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in df.dtypes if t in ("double", "float") and c not in but})
