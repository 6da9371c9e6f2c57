"""Charts: the data by Spark over all rows, the drawing in text from what is drawn: bars, columns or cells of a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import num
from ..functions.expressions import Scope
from ..plans.stages import Stage

BLOCKS, MARKS = "▏▎▍▌▋▊▉█", "*+ox#@"


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal bins over the values: bin, low, high, n. The largest value lies in the last bin."""
    v = df.select(num(Scope(df).field(column)).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    # One row: an aggregate without keys.
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.filter("lo IS NOT NULL").select("lo", "hi", F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.2f}".rstrip("0").rstrip(".")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def draw(df: DataFrame, chart: Stage, width: int = 100) -> str:
    kind = chart.kind.removesuffix("chart")
    title = " ".join(chart.options.get("title", []))
    x = chart.options.get("xcolumn", [df.columns[0]])[0]
    ys = chart.options.get("ycolumns") or [n for n in numeric_columns(df) if n != x] or numeric_columns(df)
    head = f"{title}\n" if title else ""
    if kind == "histogram":
        column = chart.options.get("xcolumn", ys)[0]
        rows = histogram(df, column, int(chart.options.get("bins", ["10"])[0])).orderBy("bin").collect()
        return head + bars([(f"{number(r.low)} - {number(r.high)}", float(r.n)) for r in rows], width)
    if not ys:
        return head + "(no data)"
    values = df.select(F.col(f"`{x}`").alias("x"), *[num(Scope(df).field(y)).cast("double").alias(f"y{k}") for k, y in enumerate(ys)])
    if kind == "bar":
        return head + bars(flat(values, ys), width)
    if kind == "column":
        return head + columns(values, ys, width)
    if kind == "pie":
        slices = [(n, v) for n, v in flat(values, ys) if v > 0]
        total = sum(v for _, v in slices) or 1.0
        return head + bars([(f"{n} {100 * v / total:.1f}%", v) for n, v in slices], width)
    return head + plot(values, ys, width)


def flat(values: DataFrame, names: list[str]) -> list[tuple[str, float]]:
    """A label and a value for each row and y column; where there are several such columns, the label names them."""
    label = lambda x, n: f"{x}/{n}" if len(names) > 1 else str(x)
    return [(label(r[0], n), v) for r in values.toLocalIterator() for n, v in zip(names, r[1:], strict=True) if v is not None]


def bars(pairs: list[tuple[str, float]], width: int) -> str:
    if not pairs:
        return "(no data)"
    room = max(len(n) for n, _ in pairs)
    space, most = max(10, width - room - 14), max(abs(v) for _, v in pairs) or 1.0
    lines = []
    for n, v in pairs:
        eighths = round(abs(v) / most * space * 8)
        lines.append(f"{n:<{room}}  {BLOCKS[-1] * (eighths // 8)}{BLOCKS[eighths % 8 - 1] if eighths % 8 else ''} {number(v)}")
    return "\n".join(lines)


def columns(values: DataFrame, names: list[str], width: int, height: int = 12) -> str:
    """The first columns that there is room for, on the scale of all."""
    ys = [f"y{k}" for k in range(len(names))]
    found = values.agg(*[F.count(y) for y in ys], *[F.max(y) for y in ys]).first()
    n, highs = sum(found[: len(ys)]), [v for v in found[len(ys) :] if v is not None]
    if not n:
        return "(no data)"
    room = max(1, width // 4)
    pairs = flat(values.filter(F.coalesce(*ys).isNotNull()).limit(room), names)[:room]
    most = max(highs) or 1.0
    lines = ["".join(" ██ " if v / most * height >= h else "    " for _, v in pairs).rstrip() for h in range(height, 0, -1)]
    left = [f"(first {len(pairs)} of {n} columns)"] if n > len(pairs) else []
    return "\n".join([*lines, "─" * (4 * len(pairs)), "".join(f"{n[:3]:^4}" for n, _ in pairs), *left])


def in_order(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their place `i` by x (nulls last, ties in the order they came), without a window over all rows; and the
    cached frame they come from."""
    dealt = values.withColumn("tie", F.monotonically_increasing_id()).orderBy(F.col("x").asc_nulls_last(), "tie")
    dealt = dealt.withColumn("at", F.monotonically_increasing_id()).persist()
    # The upper bits are the partition, the lower 33 the row in it.
    part, start, starts = F.shiftright("at", 33), 0, {}
    for p, n in sorted(dealt.groupBy(part.alias("p")).count().collect()):
        starts[p], start = start, start + n
    before = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1)])
    return dealt.withColumn("i", F.element_at(before, part.cast("int") + 1) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), dealt


def plot(values: DataFrame, names: list[str], width: int, height: int = 15) -> str:
    wide = max(20, width - 12)
    placed, cached = in_order(values)
    try:
        series = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"y{k}").alias("y")) for k in range(len(names))]))
        points = placed.select("i", series.alias("s")).select("i", "s.k", "s.y").filter("y IS NOT NULL AND NOT isnan(y)")
        x0, x1, y0, y1 = points.agg(F.min("i"), F.max("i"), F.min("y"), F.max("y")).first()
        if x0 is None or not math.isfinite(y0) or not math.isfinite(y1):
            return "(no data)"
        column = F.bround((F.col("i") - x0) / float(x1 - x0 or 1) * (wide - 1)).cast("int")
        row = F.bround((F.col("y") - y0) / float(y1 - y0 or 1) * (height - 1)).cast("int")
        cells = sorted(tuple(r) for r in points.select("k", column.alias("c"), row.alias("r")).distinct().collect())
    finally:
        cached.unpersist()
    grid = [[" "] * wide for _ in range(height)]
    for k, c, r in cells:
        grid[height - 1 - r][c] = MARKS[k % len(MARKS)]
    scale = {0: number(y1), height - 1: number(y0), height // 2: number((y0 + y1) / 2)}
    lines = [f"{scale.get(i, ''):>10} │{''.join(r).rstrip()}" for i, r in enumerate(grid)]
    return "\n".join([*lines, " " * 11 + "└" + "─" * wide, *(f"{MARKS[k % len(MARKS)]} {n}" for k, n in enumerate(names))])
