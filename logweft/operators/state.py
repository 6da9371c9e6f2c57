"""What a query has come to: a frame, the order of its rows, and a chart."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import ORD


@dataclass(frozen=True)
class State:
    df: DataFrame
    order: tuple[Column, ...] = ()
    chart: object = None

    def to(self, df: DataFrame, order: tuple[Column, ...] | None = None) -> State:
        return State(df, self.order if order is None else order)

    def with_chart(self, chart: object) -> State:
        return replace(self, chart=chart)

    def numbered(self) -> DataFrame:
        """The frame with the order of its rows in a column: after a sort by position, else as the source gives them.

        The source's order needs no shuffle; a sort's order is one range-partitioned sort."""
        if ORD in self.df.columns:
            return self.df
        df = self.df.orderBy(*self.order) if self.order else self.df
        return df.withColumn(ORD, F.monotonically_increasing_id())
