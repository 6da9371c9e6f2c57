"""python -m logweft.cli 'QUERY' FILE...: a pipeline or SQL over files or standard input."""

from __future__ import annotations

import argparse
import os
import re
import sys
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import sinks
from .engine import Engine
from .operators.numbering import checkpoint_folder
from .plans.sql import is_sql
from .plans.syntax import UNITS, QueryError
from .session import session
from .sources.text import FORMATS, read


def duration_us(text: str) -> int:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|[dhms])", text)
    if not m:
        raise QueryError(f"bad duration {text!r}")
    return round(float(m[1]) * UNITS[m[2]])


def bound(text: str) -> str:
    """A time as an expression: now, -1h, +30m, 30m, or a date."""
    if text == "now":
        return "now()"
    if m := re.fullmatch(r"([-+]?)(\d+(?:\.\d+)?(?:ms|[dhms]))", text):
        return f"ago({m[2]})" if m[1] == "-" else f"now({m[2]})"
    return f'todatetime("{text}")'


def time_filter(start: str | None, end: str | None, field: str) -> str:
    tests = [f"todatetime({field}) >= {bound(start)}"] if start else []
    tests += [f"isnotnull(todatetime({field})) and todatetime({field}) < {bound(end)}"] if end else []
    return f"where {' and '.join(tests)}" if tests else ""


def spooled(spark: SparkSession, lines: Iterable[str]) -> str:
    """Standard input as a file in the folder that driver and executors share."""
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stdin-{uuid.uuid4().hex}.log"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        for line in lines:
            out.write(line.encode())
    finally:
        out.close()
    return path


def show(lines: Iterable[str]) -> None:
    for line in lines:
        print(line)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logweft")
    p.add_argument("query")
    p.add_argument("files", nargs="*")
    p.add_argument("--lang", default="auto", choices=("auto", "kql", "sql"))
    p.add_argument("--input", default="auto", choices=FORMATS)
    p.add_argument("--pattern")
    p.add_argument("--output", default="table", choices=sinks.FORMATS)
    p.add_argument("--from", dest="start")
    p.add_argument("--to", dest="end")
    p.add_argument("--time-field", default="ts")
    p.add_argument("--color", default="auto", choices=("auto", "always", "never"))
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-A", "--after", type=int, default=0)
    p.add_argument("-B", "--before", type=int, default=0)
    p.add_argument("-T", "--around", default="")
    a = p.parse_args(argv)
    try:
        spark = session()
        engine = Engine(spark, fmt=a.input, pattern=a.pattern)
        files = [f for f in a.files if f != "-"]
        sql = is_sql(a.query) if a.lang == "auto" else a.lang == "sql"
        if "-" in a.files or (not a.files and not sql):
            files.append(spooled(spark, sys.stdin))
        source = read(spark, files, a.input, a.pattern) if files else None
        limits = time_filter(a.start, a.end, a.time_field) if source is not None else ""
        kept = engine.run(limits, source).df if limits else source
        colour = a.color == "always" or (a.color == "auto" and sys.stdout.isatty() and "NO_COLOR" not in os.environ)
        before, after = max(a.context, a.before), max(a.context, a.after)
        if before or after or a.around:
            query = f"{limits} | {a.query}" if limits else a.query
            df = engine.context(query, source, before, after, duration_us(a.around) if a.around else 0, a.time_field)
            show(sinks.context_lines(df, colour) if a.output == "table" else sinks.lines(df, a.output))
            return 0
        result = engine.run(a.query, kept, sql)
        if result.chart and a.output == "table":
            print(result.draw(int(os.environ.get("COLUMNS", "100"))))
        else:
            show(sinks.lines(result.df, a.output, colour))
        return 0
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
