"""Registered queries against their SQL, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from logweft.format_queries import FORMATS
from logweft.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
OTHERS = ["fn_url", "fn_timespan", "fn_finite", "fn_now", "fn_day_edges", "fn_pack_array", "fn_log", "fn_trim", "agg_arg_star", "sql_left_join", "sql_right_join", "sql_full_join", "sql_cast", "sql_names", "sql_offset", "sql_functions", "render_rows", "index_map", "time_range", "sql_by_name", "serialize_rn", "context_lines", "context_time"]


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(f"{float(v):.9g}") if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", [*FORMATS, *OTHERS])
def test_query(spark, tables, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    found = tables.execute(oracle_sql()[name])
    place = [d[0] for d in found.description]
    assert sorted(place) == names
    assert got == sorted(repr([plain(r[place.index(n)]) for n in names]) for r in found.fetchall()) and got


def test_numbers_over_many_partitions(spark):
    from logweft.operators.numbering import running
    from pyspark.sql import functions as F

    df = spark.range(1000).repartition(7).withColumn("flag", F.col("id") % 3 == 0)
    rows = running(df, "n", 5, order=(F.col("id").desc(),)).collect()
    assert [r.n for r in sorted(rows, key=lambda r: -r.id)] == list(range(5, 1005))
    rows = running(df, "n", flag=F.col("flag"), order=(F.col("id"),)).collect()
    assert all(r.n == r.id // 3 + 1 for r in rows)


def test_lines_are_numbered_in_each_split(spark, tmp_path):
    from logweft.sources.text import read

    (tmp_path / "a.log").write_text("".join(f"{'' if i % 10 == 3 else f'line {i}'}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read(spark, [str(tmp_path / "a.log")] * 2, "raw")
        assert df.rdd.getNumPartitions() > 8
        got = sorted((r["_line"], r["_raw"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted([(i, f"line {i}") for i in range(1, 5001) if i % 10 != 3] * 2)


def test_auto_keeps_malformed_objects(spark, tmp_path):
    from logweft.sources.text import read

    (tmp_path / "a.log").write_text('{"a":1}\n{"a":bad}\n{oops}\n{}\n{x y=2}\n')
    got = sorted(((r["_line"] or 0, r["_raw"]) for r in read(spark, str(tmp_path / "a.log"), "auto").collect()), key=str)
    assert [g for g in got if g[0]] == [(2, '{"a":bad}'), (3, "{oops}"), (5, "{x y=2}")] and len(got) == 5


def test_levels_have_the_usual_colours():
    from logweft.sinks import COLOURS

    assert COLOURS["severe"] == COLOURS["error"] == "31" and COLOURS["emerg"] == COLOURS["fatal"] == "1;31" and COLOURS["notice"] == "32" and COLOURS["verbose"] == "36" and COLOURS["debug"] == "90"
