"""The engine: compiles a query once into a Spark plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import DataType

from .functions.coerce import Typed
from .functions.scalar import register
from .operators import joins as _joins  # noqa: F401  (registers its stages)
from .operators.charts import draw
from .operators.context import around
from .operators.relational import STAGES
from .operators.state import State
from .plans.sql import is_sql, parse_sql, sql_source
from .plans.stages import Source, Stage, parse
from .plans.syntax import QueryError
from .sources.text import read


@dataclass
class Result:
    df: DataFrame
    chart: Stage | None = None

    def draw(self, width: int = 100) -> str:
        return draw(self.df, self.chart, width) if self.chart else ""


class Engine:
    """Queries over tables by name (frames, a folder of parquet tables, the session's catalog) and over files.

    compat: a summarize without keys over no rows gives no row."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, folder: str | None = None, fmt: str = "auto", pattern: str | None = None, compat: bool = False):
        self.spark, self.tables, self.folder, self.fmt, self.pattern, self.compat = spark, dict(tables or {}), folder, fmt, pattern, compat

    def define(self, name: str, f: Callable[..., Column], returns: str = "string") -> None:
        """Make a function of columns known to queries; its result has the type `returns`."""
        register(name.lower())(lambda *xs: Typed(f(*[x.col for x in xs]).cast(returns), DataType.fromDDL(returns)))

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name.endswith(".parquet"):
            return self.spark.read.parquet(name)
        if "/" in name or "." in name:
            return read(self.spark, name, self.fmt, self.pattern)
        if self.folder:
            return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise QueryError(f"unknown table {name!r}")

    def resolve(self, source: Source) -> DataFrame:
        return self.apply(self.table(source.name), source.stages).df

    def apply(self, df: DataFrame, stages: tuple[Stage, ...]) -> State:
        state = State(df)
        for st in stages:
            state = STAGES[st.op](state, st, self)
        return state

    def run(self, query: str, source: str | DataFrame | None = None, sql: bool | None = None) -> Result:
        """A pipeline over the source, or SQL (whose FROM names it, if none is given); sql: which of both, where the query
        shall not say so itself."""
        if is_sql(query) if sql is None else sql:
            stages = parse_sql(query)
            source = source if source is not None else sql_source(query)
        else:
            stages = parse(query)
        df = source if isinstance(source, DataFrame) else self.table(source) if source else self.spark.range(1).select()
        state = self.apply(df, stages)
        return Result(state.df, state.chart)

    def context(self, query: str, source: str | DataFrame, before: int = 0, after: int = 0, span_us: int = 0, time_field: str = "ts", order: str | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
        """The rows around those that the query keeps, out of all rows. order: a column that gives the order."""
        from pyspark.sql import functions as F

        from .functions.aggregates import ORD

        df = source if isinstance(source, DataFrame) else self.table(source)
        rows = df.withColumn(ORD, F.col(order)) if order else df.withColumn(ORD, F.monotonically_increasing_id())
        return around(rows, self.apply(rows, parse(query)).df, before, after, span_us, time_field, partition)
