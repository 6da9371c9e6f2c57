import datetime as dt

import pytest

from logweft.engine import Engine
from logweft.plans.syntax import QueryError

ROWS = [("INFO", "auth", 40.0, "a"), ("ERROR", "auth", 812.0, "b"), ("ERROR", "api", 150.0, "a"), ("INFO", "api", 88.0, "c"), ("WARN", "auth", 300.0, "a"), ("ERROR", "api", 540.0, "b")]


@pytest.fixture(scope="module")
def engine(spark):
    s = spark.createDataFrame(ROWS, "level string, service string, ms double, user string").coalesce(1)
    teams = spark.createDataFrame([("auth", "identity", 1.0), ("api", "gateway", 2.0)], "service string, team string, tier double")
    nulls = spark.createDataFrame([(1, None, None), (2, "", 5.0), (3, "x", -1.0)], "id long, t string, v double").coalesce(1)
    lists = spark.createDataFrame([(1, ["a", "b"], [1.0]), (2, [], [2.0]), (3, None, None)], "id long, a array<string>, b array<double>").coalesce(1)
    return Engine(spark, {"s": s, "teams": teams, "nulls": nulls, "lists": lists})


def rows(engine, query, source="s"):
    return [tuple(r) for r in engine.run(query, source).df.collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ('where level == "ERROR" | count', [(3,)]),
        ('where level == "ERROR" | summarize n=count() by service | sort by n', [("api", 2), ("auth", 1)]),
        ('extend b=case(ms<100,"lo",ms<400,"mid","hi") | summarize n=count() by b | sort by b asc', [("hi", 2), ("lo", 2), ("mid", 2)]),
        ('where level in ("ERROR","WARN") and ms between (200 .. 600) | count', [(2,)]),
        ("top 2 by ms | project ms", [(812.0,), (540.0,)]),
        ("sort by ms | take 1 | project ms", [(812.0,)]),
        ("summarize arg_max(ms, service, user)", [(812.0, "auth", "b")]),
        ("summarize l=make_list(ms), s=make_set(level), c=countif(ms>100)", [([40.0, 812.0, 150.0, 88.0, 300.0, 540.0], ["INFO", "ERROR", "WARN"], 4)]),
        ('where service == "auth" | summarize dcount(user), min(ms), max(ms), sum(ms), avg(ms)', [(2, 40.0, 812.0, 1152.0, 384.0)]),
        ("serialize rn=row_number() | summarize a=min(rn), b=max(rn)", [(1, 6)]),
        ("serialize rn=row_number(10) | take 1 | project rn", [(10,)]),
        ("join kind=inner (teams) on service | where service1 == \"api\" | count", [(3,)]),
        ('join kind=leftanti (teams | where tier > 1) on service | count', [(3,)]),
        ("lookup teams on service | where team == \"identity\" | count", [(3,)]),
        ('union (s | where level=="WARN") | count', [(7,)]),
        ("sample 2 | count", [(2,)]),
        ("sample-distinct 2 of service", [("auth",), ("api",)]),
        ("distinct level | count", [(3,)]),
        ("project-away u*, ms | take 1", [("INFO", "auth")]),
        ("project-reorder ms | take 1", [(40.0, "INFO", "auth", "a")]),
        ("project-rename lvl=level, x=nothing | project lvl | take 1", [("INFO",)]),
        ('where user has "A" and level contains "err" | count', [(1,)]),
        ('where level matches "^E" or not (ms > 40) | count', [(4,)]),
        ('where level !in ("INFO") | count', [(4,)]),
    ],
)
def test_pipelines(engine, query, expected):
    assert rows(engine, query) == expected


@pytest.mark.parametrize(
    "query, ids",
    [
        ('where t == ""', [1, 2]),
        ('where t != "x"', [1, 2]),
        ("where v < 0", [1, 3]),
        ("where v > 0", [2]),
        ("where not (v > 0)", [1, 3]),
        ("where v == null", [1]),
        ("where isempty(t)", [1, 2]),
        ("where t", [3]),
        ("sort by v asc", [1, 3, 2]),
        ("sort by v", [2, 3, 1]),
    ],
)
def test_null_is_the_lowest_value(engine, query, ids):
    assert [r[0] for r in rows(engine, query + " | project id", "nulls")] == ids


def test_sets_beside_other_aggregates(engine):
    assert rows(engine, "summarize s=make_set(user), n=count(), t=make_set(level) by service | sort by service asc") == [("api", ["a", "c", "b"], 3, ["ERROR", "INFO"]), ("auth", ["a", "b"], 3, ["INFO", "ERROR", "WARN"])]
    assert rows(engine, "summarize s=make_set(t) by v | sort by v asc", "nulls") == [(None, []), (-1.0, ["x"]), (5.0, [""])]
    assert rows(engine, 'where level == "none" | summarize make_set(ms)') == [([],)]
    assert rows(Engine(engine.spark, engine.tables, compat=True), 'where level == "none" | summarize make_set(ms)') == []


def test_sum_of_nothing_is_zero(engine):
    assert rows(engine, 'where level == "none" | summarize sum(ms), avg(ms)') == [(0.0, None)]
    compat = Engine(engine.spark, engine.tables, compat=True)
    assert rows(compat, 'where level == "none" | summarize sum(ms)') == []


def test_mv_expand_pads_and_keeps_empty_rows(engine):
    assert rows(engine, "mv-expand a, b | sort by id asc, a asc", "lists") == [(1, "a", 1.0), (1, "b", None), (2, None, 2.0), (3, None, None)]


def test_parse_stops_where_a_literal_is_missing(spark):
    df = spark.createDataFrame([(1, "user=alice ip=10.0.0.1 done"), (2, "user=bob"), (3, "none")], "id long, m string")
    out = Engine(spark, {"t": df}).run('parse m with "user=" u " ip=" ip " " * | project id, u, ip | sort by id asc', "t").df
    assert [tuple(r) for r in out.collect()] == [(1, "alice", "10.0.0.1"), (2, "bob", None), (3, None, None)]


@pytest.mark.parametrize(
    "expr, value",
    [
        ("1 + 2 * 3", 7), ("7 / 2", 3.5), ("7 % 0", None), ("1 / 0", None), ('"10" > "9"', True), ('"10" == "10.0"', True), ('"b" > "a"', True), ('substring("hello", 1, 3)', "ell"), ('substring("hello", -3, 2)', "ll"),
        ('split("a.b.c", ".", 1)', "b"), ('indexof("abc", "c")', 2), ('trim("xy", "xyaxy")', "a"), ("round(1.005, 2)", 1.0), ("round(2.5)", 3.0), ("round(0 - 2.5)", -3.0), ("bin(7, 2)", 6.0), ('tolong("12.9")', 12), ('todouble("1x")', None),
        ('tobool("false")', True), ('extract("a(b+)", 1, "xabbb")', "bbb"), ('extract("q", 1, "x")', None), ("iff(1 > 2, 1, 2)", 2), ('coalesce(null, "a")', "a"), ('strcat("a", 1, true, null)', "a1true"), ('strcat_delim("-", "a", null, "b")', "a--b"),
        ('datetime_diff("day", todatetime("2026-07-05"), todatetime("2026-07-02"))', 3), ('format_datetime(todatetime("2026-07-02T03:04:05Z"), "yyyy/MM/dd HH:mm:ss")', "2026/07/02 03:04:05"),
        ('datetime_add("month", 1, todatetime("2026-01-31"))', dt.datetime(2026, 3, 3)), ('bin(todatetime("2026-07-02"), 7d)', dt.datetime(2026, 6, 29)), ('dayofweek(todatetime("2026-07-05"))', 0),
        ("1h + 30m", dt.timedelta(minutes=90)), ("90m / 1h", 1.5), ("tostring(90m)", "01:30:00"), ('url_decode("a%20b")', "a b"), ('gettype(pack_array(1))', "array"), ("array_length(pack_array(1, 2))", 2), ("min_of(3, 1, 2)", 1.0), ('totimespan("90m") == 90m', True),
    ],
)
def test_expressions(engine, expr, value):
    assert rows(engine, f"print x = {expr}") == [(value,)]


@pytest.mark.parametrize("query", ["wher x", "where", "summarize by x", "take x", "project", "where foo(1) > 2", "summarize nope(ms)", "join kind=odd (teams) on service", "where a ~ b", "| count", "summarize percentile(ms, 200)", 'where level matches "("'])
def test_bad_queries_are_refused(engine, query):
    with pytest.raises(QueryError):
        engine.run(query, "s")


def test_a_function_of_ones_own(engine):
    from pyspark.sql import functions as F

    engine.define("twice", lambda x: x * 2, "double")
    assert rows(engine, "where twice(ms) > 1000 | summarize s=sum(twice(ms))") == [(2704.0,)]
    engine.define("initial", lambda x: F.substring(x, 1, 1))
    assert rows(engine, 'print x = initial("abc")') == [("a",)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    from logweft import cli

    f = tmp_path / "a.log"
    f.write_text('{"level":"ERROR","ts":"2026-07-02T10:00:01Z","n":1}\n{"level":"INFO","ts":"2026-07-02T10:00:02Z","n":2}\n{"level":"INFO","ts":"2026-07-02T10:00:09Z","n":3}\n')
    assert cli.main(["select n from logs where n > 1", str(f), "--lang", "kql"]) == 2
    assert cli.main(["SELECT COUNT(*) AS c FROM logs", str(f), "--lang", "sql", "--output", "tsv"]) == 0
    assert capsys.readouterr().out == "c\n3\n"
    assert cli.main(["project n", str(f), "--from", "2026-07-02T10:00:02Z", "--to", "2026-07-02T10:00:09Z", "--output", "ndjson"]) == 0
    assert capsys.readouterr().out == '{"n": 2.0}\n'
    assert cli.main(['where level == "ERROR"', str(f), "-A", "1", "--color", "always"]) == 0
    assert "\x1b[31mERROR" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO("a=1\na=2\n"))
    assert cli.main(["summarize s=sum(a)", "--output", "tsv"]) == 0
    assert capsys.readouterr().out == "s\n3\n"


def test_sql(engine):
    q = "SELECT service, COUNT(*) AS n, ROUND(AVG(ms), 1) AS a FROM s WHERE level <> 'INFO' GROUP BY service HAVING COUNT(*) > 1 ORDER BY a DESC"
    assert rows(engine, q, None) == [("auth", 2, 556.0), ("api", 2, 345.0)]
    assert rows(engine, "SELECT DISTINCT UPPER(level) AS u FROM s ORDER BY u LIMIT 2 OFFSET 1", None) == [("INFO",), ("WARN",)]
    assert rows(engine, "SELECT t.team, COUNT(*) AS n FROM s l JOIN teams t ON l.service = t.service GROUP BY t.team ORDER BY t.team", None) == [("gateway", 3), ("identity", 3)]
    for bad in ("SELECT", "SELECT a FROM", "SELECT a FROM s CROSS JOIN teams", "SELECT level FROM s GROUP BY level", "SELECT a FROM s LIMIT x"):
        with pytest.raises(QueryError):
            engine.run(bad)


def test_context(engine):
    out = engine.context("where ms > 800", "s", before=1, after=1)
    assert [(r[0], r.ms) for r in out.collect()] == [("", 40.0), (">", 812.0), ("", 150.0)]
    with pytest.raises(QueryError):
        engine.context("count", "s", before=1)


def test_chart(engine):
    assert engine.run("summarize n=count() by service | render bar", "s").draw().count("█") > 10
    assert engine.run("summarize n=count() by service | render bar | where n > 0", "s").chart is None


def test_charts_take_all_rows_and_columns(spark):
    df = spark.range(6000).selectExpr("5999 - id AS x", "CASE WHEN id = 5999 THEN 5999 ELSE 1 END AS y", "id AS z").coalesce(1)
    draw = lambda query, of=df: Engine(spark).run(query, of).draw().split("\n")
    pie = draw("project x, y | render pie")
    assert len(pie) == 6000 and pie[-1].startswith("0 50.0%")
    line = draw("project x, z | render line")
    assert line[0].startswith("      5999 │*") and line[14].startswith("         0 │ ") and line[14].endswith("*") and len(line[14]) == 100
    columns = draw("project x, y | render column")
    assert columns[0] == "" and columns[-1] == "(first 25 of 6000 columns)"
    two = df.filter("x < 2")
    assert [b.split()[0] for b in draw("render bar", two)] == ["1/y", "1/z", "0/y", "0/z"]
    assert [b.split()[0] for b in draw("render pie", two)] == ["1/y", "1/z", "0/y", "0/z"]
    assert draw("render column", two)[-1] == "1/y 1/z 0/y 0/z "
    assert draw("extend a=1, b=2, c=3, d=4, e=5 | render line", two)[-1] == "* e"
    assert draw("where x < 0 | render line") == ["(no data)"]


def test_output_has_all_rows(spark, tmp_path, capsys):
    import json

    from logweft import cli, sinks

    df = spark.range(10_050).selectExpr("id", "'é' AS t")
    want = [{"id": i, "t": "é"} for i in range(10_050)]
    assert sinks.render(df, "json") == json.dumps(want, indent=2, ensure_ascii=False) and sinks.render(df.limit(0), "json") == "[]"
    assert [json.loads(x) for x in sinks.render(df, "ndjson").split("\n")] == want
    assert len(sinks.render(df, "tsv").split("\n")) == 10_051
    assert sinks.render(df).split("\n")[-1] == "10049  é" and len(sinks.render(df).split("\n")) == 10_052
    assert sinks.render(df.limit(0)) == "id  t\n--  -"
    assert sinks.context_table(df.selectExpr("id", "id < 10000 AS _group")).split("\n")[10_002:10_004] == ["--", "10000"]
    (tmp_path / "a.log").write_text("".join(f"x{i}\n" for i in range(10_050)))
    assert cli.main(["project _raw", str(tmp_path / "a.log"), "--input", "raw", "--output", "tsv"]) == 0
    assert capsys.readouterr().out.split("\n")[:-1] == ["_raw", *(f"x{i}" for i in range(10_050))]


def test_filter_reaches_the_scan(spark):
    from logweft.queries import engine as over

    df = over(spark, "/root/testdata/sf0.001").run('where value > 50 and event_type == "click" | project event_id', "events").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value" in plan and "EqualTo(event_type" in plan and "props" not in plan.split("ReadSchema")[1]


def test_sources(spark, tmp_path):
    from logweft.sources.text import read

    f = tmp_path / "a.log"
    f.write_text('{"level":"INFO","ms":40,"meta":{"region":"us"}}\nlevel=WARN ms=7 msg="a b" flag\n\nplain text\n')
    out = {r["_line"]: r for r in read(spark, str(f), "auto").collect()}
    assert out[None].ms == 40.0 and out[2].msg == "a b" and out[4]["_raw"] == "plain text"
    (tmp_path / "b.csv").write_text("ts,ms,ok,code\nx,1.5,true,007\ny,2,false,10\n")
    assert [tuple(r) for r in read(spark, str(tmp_path / "b.csv"), "csv").collect()] == [(2, "x", 1.5, True, "007"), (3, "y", 2.0, False, "10")]
    (tmp_path / "c.txt").write_text("1.2.3.4 GET 200\nbroken\n")
    got = read(spark, str(tmp_path / "c.txt"), "regex", r"(?P<ip>\S+) (?P<m_ethod>\w+) (?P<status>\d+)").orderBy("_line").collect()
    assert (got[0].ip, got[0].status, got[1].ip) == ("1.2.3.4", 200.0, None)
    (tmp_path / "d.json").write_text('{"a":1}\n{"a":\n{"a":2}\n')
    got = sorted((r["a"] or 0, r["_raw"]) for r in read(spark, str(tmp_path / "d.json"), "json").collect())
    assert got == [(0, '{"a":'), (1.0, None), (2.0, None)]
    with pytest.raises(QueryError):
        read(spark, str(f), "regex")


@pytest.mark.parametrize("fmt", ["logfmt", "auto"])
def test_every_key_is_a_column(spark, tmp_path, fmt):
    from logweft.sources.text import read

    f = tmp_path / "a.log"
    f.write_text("".join(" ".join(f"k{k:04}={k}" for k in range(a, a + 100)) + " ok=true zz=x7\n" for a in range(0, 1200, 100)))
    df = read(spark, str(f), fmt)
    assert len(df.columns) == 1204 and dict(df.dtypes)["k1199"] == "double" and dict(df.dtypes)["ok"] == "boolean"
    assert Engine(spark).run('where k1199 == 1199 and zz == "x7" | count', df).df.first()[0] == 1


def test_stream(spark, tmp_path):
    from logweft.streaming.queries import over_stream

    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "value", "event_type")
    base.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    query = "where value > 50 | summarize n = count() by hour = bin(ts, 1h), event_type"
    q = over_stream(Engine(spark), stream, query).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    expected = Engine(spark).run(query, base).df
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, expected.collect()))
    with pytest.raises(QueryError):
        over_stream(Engine(spark), stream, "sort by ts")
