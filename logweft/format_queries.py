"""Queries over text formats, files and streams: tables written as text to the shared folder, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .engine import Engine
from .operators.numbering import checkpoint_folder
from .sources.text import read


def fresh_path(spark: SparkSession, what: str) -> str:
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, line: Column, what: str, head: str | None = None, order: str | None = None) -> str:
    """The path of a folder of text files with a line for each row; with a head line, of one file that begins with it and
    has the lines by the column `order`."""
    path = fresh_path(df.sparkSession, what)
    if head is None:
        df.select(line.alias("value")).write.text(path)
    else:
        rows = df.select(F.col(order).cast("long").alias("k"), line.alias("value"))
        rows = rows.union(df.sparkSession.createDataFrame([(-1, head)], "k long, value string"))
        rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Engine(spark, folder=sf_dir).table(name)


#: Whole numbers as text, so that any reader finds the same number.
_CENTS = "string(bigint(floor(value * 100)))"


def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, one of them cut off."""
    events = _table(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", "event_type", F.struct("user_id").alias("who")))
    path = written(events, F.when(F.col("event_id") == 7, F.lit('{"event_id": 7, "ev')).otherwise(whole), "json")
    df = read(spark, path, "json")
    return Engine(spark).run("project id = event_id, kind = event_type, user = who.user_id, raw = _raw", df).df


def src_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" kind="), F.col("event_type"), F.lit(" cents="), F.expr(_CENTS), F.lit(" msg=\"a \\\"b\\\" "), F.col("event_type"), F.lit("\" one='x y' flag version=007"))
    df = read(spark, written(_table(spark, sf_dir, "events"), line, "logfmt"), "logfmt")
    return df.select("id", "kind", "cents", "msg", "one", "flag", "version")


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(",\""), F.col("p_name"), F.lit(", \"\"x\"\"\","), F.col("p_brand"))
    return read(spark, written(_table(spark, sf_dir, "part"), line, "csv", "id,name,brand", "p_partkey"), "csv").select("id", "name", "brand")


def src_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.lit("true"))
    return read(spark, written(_table(spark, sf_dir, "part"), line, "tsv", "id\tname\tok", "p_partkey"), "tsv").select("id", "name", "ok")


def src_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.concat(F.lit('10.0.0.1 "GET /'), F.col("event_type"), F.lit('" '), F.col("user_id").cast("string"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(hit)
    df = read(spark, written(_table(spark, sf_dir, "events"), line, "regex"), "regex", r'(?P<ip>\S+) "(?P<method>\S+) /(?P<path>\S+)" (?P<user>\d+)')
    return Engine(spark).run("extend bad = isnull(ip), raw = iff(isnull(ip), _raw, \"\") | summarize n = count(), total = sum(user) by path, method, bad", df).df


def src_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines keep their numbers, whichever lines are blank."""
    nations = _table(spark, sf_dir, "nation")
    path = written(nations, F.when(F.col("n_nationkey") % 4 == 1, F.lit("  ")).otherwise(F.col("n_name")), "raw", "first", "n_nationkey")
    return read(spark, path, "raw").select(F.col("_line").alias("line"), F.col("_raw").alias("raw"))


def src_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turns an object, pairs, plain text, and what begins and ends like an object and is none."""
    k, id_ = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit('{"id": '), id_, F.lit(', "kind": "'), F.col("event_type"), F.lit('"}')))
    line = line.when(k == 1, F.concat(F.lit("id="), id_, F.lit(" kind="), F.col("event_type"))).when(k == 2, F.concat(F.lit("plain "), id_)).otherwise(F.concat(F.lit('{"id":bad '), id_, F.lit("}")))
    df = read(spark, written(_table(spark, sf_dir, "events"), line, "auto"), "auto")
    return df.select("id", "kind", F.col("_raw").alias("raw"), F.col("_line").isNotNull().alias("numbered"))


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FROM 'file', and several files one after the other."""
    nation = _table(spark, sf_dir, "nation")
    line = F.to_json(F.struct("n_nationkey", "n_name"))
    path = written(nation, line, "from.json", "{\"n_nationkey\": 100, \"n_name\": \"X\"}", "n_nationkey")
    two = Engine(spark).run("count", read(spark, [path, path], "json")).df.withColumnRenamed("count", "n")
    return Engine(spark, fmt="json").run(f"SELECT COUNT(*) AS n FROM '{path}' WHERE n_nationkey < 200").df.union(two)


def _sink(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, folder=sf_dir).run('where event_type != "view" | project id = event_id, kind = event_type, user = user_id', "events").df
        if fmt == "tsv":
            df = df.coalesce(1)  # a file has its own head line
        path = fresh_path(spark, fmt)
        sinks.write(df, path, fmt)
        return read(spark, path, {"ndjson": "json"}.get(fmt, fmt)).select("id", "kind", "user")

    return query


def stream_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summarize by hours over a stream of the table's rows, up to their end."""
    from .streaming.queries import over_stream

    # A stream reads folders.
    path = fresh_path(spark, "events")
    events = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    name = f"stream_{uuid.uuid4().hex}"
    counted = over_stream(Engine(spark), stream, "where value > 50 | summarize n = count(), total = sum(user_id) by hour = bin(ts, 1h), event_type")
    run = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


FORMATS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "src_json": (src_json, """SELECT CASE WHEN event_id <> 7 THEN event_id::DOUBLE END AS id, CASE WHEN event_id <> 7 THEN event_type END AS kind, CASE WHEN event_id <> 7 THEN user_id::DOUBLE END AS user, CASE WHEN event_id = 7 THEN '{"event_id": 7, "ev' END AS raw FROM events"""),
    "src_logfmt": (src_logfmt, """SELECT event_id::DOUBLE AS id, event_type AS kind, floor(value * 100) AS cents, 'a "b" ' || event_type AS msg, 'x y' AS one, true AS flag, '007' AS version FROM events"""),
    "src_csv": (src_csv, """SELECT p_partkey::DOUBLE AS id, p_name || ', "x"' AS name, p_brand AS brand FROM part"""),
    "src_tsv": (src_tsv, "SELECT p_partkey::DOUBLE AS id, p_name AS name, true AS ok FROM part"),
    "src_regex": (src_regex, "SELECT CASE WHEN event_type <> 'error' THEN event_type END AS path, CASE WHEN event_type <> 'error' THEN 'GET' END AS method, event_type = 'error' AS bad, count(*) AS n, coalesce(sum(CASE WHEN event_type <> 'error' THEN user_id END), 0)::DOUBLE AS total FROM events GROUP BY ALL"),
    "src_raw": (src_raw, "SELECT 1::BIGINT AS line, 'first' AS raw UNION ALL SELECT n_nationkey + 2, n_name FROM nation WHERE n_nationkey % 4 <> 1"),
    "src_auto": (src_auto, """SELECT CASE WHEN event_id % 4 < 2 THEN event_id::DOUBLE END AS id, CASE WHEN event_id % 4 < 2 THEN event_type END AS kind,
        CASE event_id % 4 WHEN 1 THEN 'id=' || event_id || ' kind=' || event_type WHEN 2 THEN 'plain ' || event_id WHEN 3 THEN '{"id":bad ' || event_id || '}' END AS raw, event_id % 4 <> 0 AS numbered FROM events"""),
    "src_files": (src_files, "SELECT count(*) + 1 AS n FROM nation UNION ALL SELECT 2 * count(*) + 2 FROM nation"),
    "sink_ndjson": (_sink("ndjson"), "SELECT event_id::DOUBLE AS id, event_type AS kind, user_id::DOUBLE AS user FROM events WHERE event_type <> 'view'"),
    "sink_tsv": (_sink("tsv"), "SELECT event_id::DOUBLE AS id, event_type AS kind, user_id::DOUBLE AS user FROM events WHERE event_type <> 'view'"),
    "sink_parquet": (_sink("parquet"), "SELECT event_id AS id, event_type AS kind, user_id AS user FROM events WHERE event_type <> 'view'"),
    "stream_bin": (stream_bin, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(user_id) AS total FROM events WHERE value > 50 GROUP BY 1, 2"),
}
