"""Readers of log text: json, auto, logfmt, csv, tsv, regex, raw; and parquet."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import QueryError

LINE, RAW, CORRUPT = "_line", "_raw", "__corrupt"
NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?$"
FORMATS = ("json", "ndjson", "auto", "logfmt", "csv", "tsv", "regex", "raw", "text", "parquet")
_PAIR = r"""([^\s=]+)(?:=("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^ ]*))?"""
#: Where key=value pairs are seen.
HINT = r"(^|\s)[A-Za-z0-9_.\-]+="


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """_line and _raw, one row for each line that isn't blank. Numbers count from 1 in each file, blanks too.

    A first pass counts the lines of each split of a file; a line's number is those of the splits before and its place in
    its own, which the scan gives. Lines are never moved; what is sent to all tasks is a row for each split, some 100 bytes
    for its 128 MB of text."""
    parts = []
    for path in paths:
        text = spark.read.text(path).select(F.col("value").alias(RAW), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__m"))
        # A row for each split.
        splits = text.groupBy(F.col("__f").alias("__f2"), F.col("__s").alias("__s2")).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("__f2").orderBy("__s2").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        numbered = text.join(F.broadcast(splits), (F.col("__f") == F.col("__f2")) & (F.col("__s") == F.col("__s2")))
        parts.append(numbered.select((F.col("__before") + F.col("__m") - F.col("__first") + 1).alias(LINE), RAW))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.withColumn(RAW, F.regexp_replace(RAW, "\r$", "")).filter(F.trim(RAW) != "")


def coerced(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns whose values are all numbers, or all booleans, become such; one pass finds out."""
    names = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if not names:
        return df
    q = lambda n: F.col(f"`{n}`")
    tests = []
    for k, n in enumerate(names):
        tests += [F.bool_and(q(n).rlike(NUMBER)).alias(f"n{k}"), F.bool_and(q(n).isin("true", "false")).alias(f"b{k}")]
    found = df.agg(*tests).collect()[0]
    kind = lambda k: "double" if found[f"n{k}"] else "boolean" if found[f"b{k}"] else None
    return df.withColumns({n: q(n).try_cast(kind(k)) for k, n in enumerate(names) if kind(k)})


def _widened(df: DataFrame) -> DataFrame:
    """All numbers as real, at any depth."""

    def wide(t: T.DataType) -> T.DataType:
        if isinstance(t, T.NumericType):
            return T.DoubleType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(wide(t.elementType))
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in t])
        return t

    return df.select(*[F.col(f"`{f.name}`").cast(wide(f.dataType)).alias(f.name) if f.name != LINE else F.col(LINE) for f in df.schema])


def read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects; a line that is none keeps _line and _raw."""
    df = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).json(paths)
    if RAW in df.columns:
        bad = lines(spark, paths)
        schema = df.schema
        parsed = bad.select(LINE, RAW, F.from_json(RAW, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW}).alias("r"))
        broken = F.col(f"r.{RAW}").isNotNull() | F.col("r").isNull()
        df = parsed.select(F.when(broken, F.col(LINE)).alias(LINE), F.when(broken, F.col(RAW)).alias(RAW), *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema if f.name not in (RAW, LINE)])
    return _widened(df)


def pairs(raw: Column) -> Column:
    """The key=value pairs of a line as a map; a bare key is true. The last of equal keys counts."""
    found = F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(0))
    key = lambda p: F.regexp_extract(p, r"^([^\s=]+)", 1)
    value = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"^[^\s=]+=((?s).*)$", 1), r"""^(["'])((?s).*)\1$""", "$2"), r"\\(.)", "$1")
    entries = F.transform(found, lambda p: F.struct(key(p).alias("k"), F.when(F.contains(p, F.lit("=")), value(p)).otherwise("true").alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def _kinds(df: DataFrame, column: str) -> dict[str, str | None]:
    """All keys of a map column in the order of their names, with the type that all values of a key have: double, boolean
    or none but text. One pass, whose size doesn't depend on the number of keys."""
    tests = F.bool_and(F.col("v").rlike(NUMBER)).alias("n"), F.bool_and(F.col("v").isin("true", "false")).alias("b")
    found = df.select(F.explode(column).alias("k", "v")).groupBy("k").agg(*tests).orderBy("k").collect()
    return {r.k: "double" if r.n else "boolean" if r.b else None for r in found}


def _value(column: str, key: str, kind: str | None) -> Column:
    value = F.col(column)[key]
    return value.try_cast(kind) if kind else value


def _spread(df: DataFrame, column: str) -> DataFrame:
    """A map's keys as columns, in the order of their names."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[_value(column, k, kind).alias(k) for k, kind in _kinds(df, column).items() if k not in rest])


def read_logfmt(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _spread(lines(spark, paths).withColumn("__kv", pairs(F.col(RAW))), "__kv")


def _inferred(spark: SparkSession, texts: DataFrame) -> T.StructType:
    """The schema of a column of JSON texts, found by the JVM's own reader."""
    jvm = spark.sparkContext._jvm
    strings = getattr(texts._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())
    found = spark._jsparkSession.read().option("columnNameOfCorruptRecord", CORRUPT).option("allowSingleQuotes", "false").json(strings)
    return T.StructType([f for f in DataFrame(found, spark).schema if f.name != CORRUPT])


def read_auto(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Line by line: an object, else key=value pairs where a key= is seen, else raw. What looks like an object and is
    none is one of the others."""
    df = lines(spark, paths)
    is_json = F.trim(RAW).startswith("{") & F.trim(RAW).endswith("}") & (F.length(F.trim(RAW)) > 1)
    schema = _inferred(spark, df.filter(is_json).select(RAW))
    parsed = F.from_json(RAW, T.StructType([*schema, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"})
    parsed = df.withColumn("__p", F.when(is_json, parsed))
    parsed = parsed.withColumn("__j", F.when(F.col(f"__p.{CORRUPT}").isNull(), F.col("__p"))).drop("__p")
    names = [f.name for f in schema if f.name not in (LINE, RAW)]
    rest = parsed.withColumn("__kv", F.when(F.col("__j").isNull() & F.col(RAW).rlike(HINT), pairs(F.col(RAW))))
    keys = _kinds(rest, "__kv")
    good = F.col("__j").isNotNull()
    columns = []
    for n in dict.fromkeys([*names, *(k for k in keys if k not in (LINE, RAW))]):
        if n in names and n in keys:
            kind = schema[n].dataType
            columns.append(F.coalesce(F.col(f"__j.`{n}`").cast("string"), F.col("__kv")[n]).try_cast("double" if isinstance(kind, T.NumericType) else kind).alias(n))
        else:
            columns.append((F.col(f"__j.`{n}`") if n in names else _value("__kv", n, keys[n])).alias(n))
    out = rest.select(F.when(~good, F.col(LINE)).alias(LINE), F.when(~good, F.col(RAW)).alias(RAW), *columns)
    return _widened(out)


def read_separated(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    df = None
    for path in paths:
        one = lines(spark, [path])
        head = one.orderBy(LINE).limit(1).collect()
        if not head:
            continue
        names = next(iter(csv.reader([head[0][RAW]], delimiter=sep)))
        body = one.filter(F.col(LINE) > head[0][LINE])
        row = F.from_csv(RAW, ", ".join(f"`{n}` string" for n in names), {"sep": sep, "mode": "PERMISSIVE", "escape": '"'})
        one = body.select(LINE, row.alias("r")).select(LINE, *[F.col(f"r.`{n}`").alias(n) for n in names])
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
    return coerced(df, [c for c in df.columns if c != LINE]) if df is not None else spark.createDataFrame([], f"{LINE} long")


def read_regex(spark: SparkSession, paths: list[str], pattern: str | None) -> DataFrame:
    if not pattern or not re.compile(pattern).groupindex:
        raise QueryError("the regex format needs a pattern with named groups")
    names = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P?<\w+>", "(", pattern)
    df = lines(spark, paths)
    hit = F.col(RAW).rlike(plain)
    return coerced(df.withColumns({n: F.when(hit, F.regexp_extract(RAW, plain, i)) for n, i in names.items()}), list(names))


def read(spark: SparkSession, paths: str | list[str], fmt: str = "auto", pattern: str | None = None) -> DataFrame:
    """Files of one format, one after the other."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt not in FORMATS:
        raise QueryError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if fmt == "parquet":
        return spark.read.parquet(*paths)
    if fmt in ("json", "ndjson"):
        return read_json(spark, paths)
    if fmt == "logfmt":
        return read_logfmt(spark, paths)
    if fmt in ("csv", "tsv"):
        return read_separated(spark, paths, "," if fmt == "csv" else "\t")
    if fmt == "regex":
        return read_regex(spark, paths, pattern)
    return lines(spark, paths) if fmt in ("raw", "text") else read_auto(spark, paths)
