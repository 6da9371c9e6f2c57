"""Queries over streams: stages that look at one row, and counts by time bucket with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.aggregates import aggregate
from ..functions.expressions import Scope
from ..operators.relational import STAGES, key_name
from ..operators.state import State
from ..plans.stages import Stage, parse
from ..plans.syntax import Call, Lit, QueryError, Span

ROW_STAGES = {"where", "project", "extend", "project-away", "project-keep", "project-rename", "project-reorder", "parse", "mv-expand", "lookup", "union"}


def over_stream(engine: Engine, stream: DataFrame, query: str, delay: str = "10 minutes") -> DataFrame:
    """The query's plan on a stream; write it with writeStream.

    summarize needs a key bin(<time column>, <duration>): it becomes a window, and `delay` its watermark. Sorts, limits
    and what numbers rows need all rows and are refused."""
    state = State(stream)
    for st in parse(query):
        if st.op in ROW_STAGES:
            state = STAGES[st.op](state, st, engine)
        elif st.op == "summarize":
            state = State(_windowed(state.df, st, delay))
        else:
            raise QueryError(f"{st.op} needs all rows and can't run on a stream")
    return state.df


def _windowed(df: DataFrame, st: Stage, delay: str) -> DataFrame:
    buckets = [i for i in st.by if isinstance(i.expr, Call) and i.expr.name in ("bin", "floor_bin") and hasattr(i.expr.args[0], "name")]
    if len(buckets) != 1:
        raise QueryError("summarize on a stream needs one key bin(time, duration)")
    item = buckets[0]
    time, width = item.expr.args[0].name, item.expr.args[1]
    us = width.us if isinstance(width, Span) else int(width.value * 1_000_000) if isinstance(width, Lit) else 0
    if us <= 0:
        raise QueryError("the duration must be a positive literal")
    # bin() counts from a Monday, windows from the epoch, a Thursday.
    start = f"{(62_135_596_800_000_000 % us and us - 62_135_596_800_000_000 % us) // 1000} milliseconds"
    df = df.withWatermark(time, delay)
    scope = Scope(df)
    keys = [scope.column(i.expr).alias(key_name(i)) for i in st.by if i is not item]
    aggs = [c.alias(n) for i in st.items for n, c in aggregate(scope, i.name, i.given, i.expr, i.name)]
    window = F.window(F.col(f"`{time}`"), f"{us} microseconds", f"{us} microseconds", start)
    out = df.groupBy(window.alias("__w"), *keys).agg(*aggs)
    return out.select(F.col("__w.start").alias(key_name(item)), *[f"`{c}`" for c in out.columns if c != "__w"])
