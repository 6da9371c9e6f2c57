"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .format_queries import FORMATS
from .operators.charts import histogram

#: name: (table, query, SQL)
PIPELINES: dict[str, tuple[str, str, str]] = {
    "where_cmp": ("events", 'where value > 100 and event_type != "error"', "SELECT * FROM events WHERE value > 100 AND event_type <> 'error'"),
    "where_in": ("events", 'where event_type in ("click", "view") | count', "SELECT count(*) AS count FROM events WHERE event_type IN ('click', 'view')"),
    "where_not_in": ("events", 'where event_type !in ("click", "view") | summarize n = count() by event_type', "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1"),
    "where_between": ("orders", "where o_totalprice between (1000 .. 50000) | count", "SELECT count(*) AS count FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "where_not_or": ("events", 'where not (event_type == "click" or value < 10) | count', "SELECT count(*) AS count FROM events WHERE NOT (event_type = 'click' OR value < 10)"),
    "where_contains": ("part", 'where p_name contains "RING" | project p_partkey, p_name', "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'"),
    "where_startswith": ("part", 'where p_type startswith "eco" | count', "SELECT count(*) AS count FROM part WHERE lower(p_type) LIKE 'eco%'"),
    "where_endswith": ("part", 'where p_name endswith "RING" | count', "SELECT count(*) AS count FROM part WHERE lower(p_name) LIKE '%ring'"),
    "where_has": ("documents", 'where text has "the" | count', "SELECT count(*) AS count FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), 'the')"),
    "where_matches": ("customer", 'where c_name matches regex "[0-4]$" | count', "SELECT count(*) AS count FROM customer WHERE regexp_matches(c_name, '[0-4]$')"),
    "where_eq_ci": ("customer", 'where c_mktsegment =~ "Building" | count', "SELECT count(*) AS count FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "where_ne_ci": ("customer", 'where c_mktsegment !~ "Building" | count', "SELECT count(*) AS count FROM customer WHERE lower(c_mktsegment) <> 'building'"),
    "project_rename_compute": ("lineitem", "project order = l_orderkey, net = l_extendedprice * (1 - l_discount) | where net > 90000", "SELECT l_orderkey AS \"order\", l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000"),
    "project_away": ("customer", "project-away c_acct*, c_name", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "project_keep": ("customer", "project-keep c_n*, c_custkey", "SELECT c_custkey, c_name, c_nationkey FROM customer"),
    "project_reorder": ("supplier", "project-reorder s_acctbal", "SELECT * FROM supplier"),
    "project_rename": ("supplier", "project-rename id = s_suppkey, balance = s_acctbal", "SELECT s_suppkey AS id, s_name, s_nationkey, s_acctbal AS balance FROM supplier"),
    "extend_parallel": ("events", "extend value = value * 2, b = value + 1 | project event_id, value, b", "SELECT event_id, value * 2 AS value, value + 1 AS b FROM events"),
    "sort_top": ("orders", "top 10 by o_totalprice, o_orderkey asc", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "sort_take": ("orders", "sort by o_orderdate asc, o_orderkey | take 25", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 25"),
    "count_all": ("lineitem", "count", "SELECT count(*) AS count FROM lineitem"),
    "distinct_cols": ("lineitem", "distinct l_returnflag, l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_star": ("nation", "distinct *", "SELECT DISTINCT * FROM nation"),
    "agg_basic": ("events", "summarize n = count(), total = sum(value), mean = avg(value), low = min(value), high = max(value) by event_type", "SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1"),
    "agg_conditional": ("events", 'summarize a = countif(value > 50), b = sumif(value, event_type == "click"), c = avgif(value, value > 50) by user_id', "SELECT user_id, count(*) FILTER (WHERE value > 50) AS a, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS b, avg(value) FILTER (WHERE value > 50) AS c FROM events GROUP BY 1"),
    "agg_dcount": ("events", "summarize users = dcount(user_id), kinds = dcount(event_type)", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events"),
    "agg_dispersion": ("events", "summarize a = stdev(value), b = stdevp(value), c = variance(value), d = varp(value) by event_type | extend a = round(a, 6), b = round(b, 6), c = round(c, 6), d = round(d, 6)", "SELECT event_type, round(stddev_samp(value), 6) AS a, round(stddev_pop(value), 6) AS b, round(var_samp(value), 6) AS c, round(var_pop(value), 6) AS d FROM events GROUP BY 1"),
    "agg_percentile": ("events", "summarize p50 = percentile(value, 50), p95 = percentile(value, 95) by event_type | extend p50 = round(p50, 6), p95 = round(p95, 6)", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"),
    "agg_default_names": ("events", "summarize count(), sum(value), dcount(user_id), countif(value > 1) by event_type", "SELECT event_type, count(*) AS count, sum(value) AS sum_value, count(DISTINCT user_id) AS dcount_user_id, count(*) FILTER (WHERE value > 1) AS countif FROM events GROUP BY 1"),
    "agg_arg_max": ("orders", "summarize arg_max(o_totalprice, o_orderkey, o_orderpriority) by o_orderstatus", "SELECT o_orderstatus, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, o_totalprice) AS o_orderkey, arg_max(o_orderpriority, o_totalprice) AS o_orderpriority FROM orders GROUP BY 1"),
    "agg_arg_min": ("events", "summarize arg_min(event_id, user_id, value) by event_type", "SELECT event_type, min(event_id)::DOUBLE::BIGINT AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value FROM events GROUP BY 1"),
    "bin_hour": ("events", "summarize n = count() by hour = bin(ts, 1h)", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1"),
    "bin_week": ("events", "summarize n = count() by week = bin(ts, 7d)", "SELECT date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n FROM events GROUP BY 1"),
    "bin_numeric": ("events", "summarize n = count() by b = bin(value, 25)", "SELECT floor(value / 25) * 25 AS b, count(*) AS n FROM events GROUP BY 1"),
    "join_inner": ("customer", "join kind=inner (nation) on c_nationkey == n_nationkey | project c_custkey, n_name", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_left": ("orders", "join kind=leftouter (customer | where c_acctbal > 5000) on o_custkey == c_custkey | project o_orderkey, c_name", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey"),
    "join_right": ("supplier", "where s_acctbal > 5000 | join kind=rightouter (nation) on s_nationkey == n_nationkey | project s_name, n_name", "SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "join_full": ("supplier", "where s_acctbal > 5000 | join kind=fullouter (nation | where n_regionkey < 3) on s_nationkey == n_nationkey | project s_name, n_name", "SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey"),
    "join_leftsemi": ("orders", "join kind=leftsemi (customer | where c_acctbal > 9000) on o_custkey == c_custkey", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)"),
    "join_leftanti": ("orders", "join kind=leftanti (customer | where c_acctbal > 5000) on o_custkey == c_custkey | count", "SELECT count(*) AS count FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "join_rightsemi": ("supplier", "join kind=rightsemi (nation) on s_nationkey == n_nationkey", "SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "join_rightanti": ("supplier", "where s_acctbal > 5000 | join kind=rightanti (nation) on s_nationkey == n_nationkey", "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    "join_collision": ("nation", "join (nation | where n_regionkey == 1) on n_regionkey | summarize n = count() by n_name, n_regionkey1", "SELECT a.n_name, b.n_regionkey AS n_regionkey1, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_regionkey = 1 GROUP BY 1, 2"),
    "lookup_left": ("events", "lookup (customer | project c_custkey, c_mktsegment) on user_id == c_custkey | project event_id, c_mktsegment", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"),
    "lookup_inner": ("events", "lookup kind=inner (customer | where c_acctbal > 0 | project c_custkey, c_name) on user_id == c_custkey | project event_id, c_name", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0"),
    "union_missing": ("customer", "project id = c_custkey, name = c_name | union (supplier | project name = s_name, balance = s_acctbal)", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT NULL, s_name, s_acctbal FROM supplier"),
    "parse_props": ("events", 'parse props with "\\"k\\": " k "}" * | project event_id, k', "SELECT event_id, regexp_extract(props, '\"k\": ([^}]*)', 1) AS k FROM events"),
    "mv_expand": ("part", 'extend w = split(p_name, " ") | mv-expand w | summarize n = count() by w', "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1"),
    "serialize_rn": ("nation", "sort by n_nationkey asc | serialize rn = row_number(1) | project n_name, rn", "SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation"),
    "sample_distinct": ("nation", "sort by n_nationkey asc | sample-distinct 3 of n_regionkey", "SELECT n_regionkey FROM (SELECT n_regionkey, min(n_nationkey) AS m FROM nation GROUP BY 1 ORDER BY m LIMIT 3)"),
    "getschema": ("nation", "getschema", "SELECT * FROM (VALUES ('n_nationkey', 0::BIGINT, 'real'), ('n_name', 1::BIGINT, 'string'), ('n_regionkey', 2::BIGINT, 'real')) v(ColumnName, ColumnOrdinal, ColumnType)"),
    "print_consts": ("nation", 'print a = 1 + 2, b = strcat("x", "-", 5), bin(7.5, 2)', "SELECT 3::BIGINT AS a, 'x-5' AS b, 6.0::DOUBLE AS print_2"),
    "fn_string": ("part", 'project p_partkey, a = toupper(p_name), b = strlen(p_name), c = substring(p_name, 1, 3), d = replace(p_name, "a", "AA"), e = indexof(p_name, "r"), f = reverse(p_name), g = strcat_delim("-", p_brand, p_type), h = trim("s", p_name), i = split(p_name, " ", 1), j = extract("([a-z]+) ", 1, p_name)', "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 2, 3) AS c, replace(p_name, 'a', 'AA') AS d, strpos(p_name, 'r') - 1 AS e, reverse(p_name) AS f, p_brand || '-' || p_type AS g, trim(p_name, 's') AS h, string_split(p_name, ' ')[2] AS i, CASE WHEN regexp_matches(p_name, '([a-z]+) ') THEN regexp_extract(p_name, '([a-z]+) ', 1) END AS j FROM part"),
    "fn_math": ("events", "project event_id, a = abs(value - 50), b = round(sqrt(value), 4), c = floor(value), d = ceiling(value), e = round(log10(value + 1), 6), f = pow(value, 2), g = sign(value - 50), h = value % 7, i = round(exp(value / 1000), 6), j = min_of(value, 10), k = max_of(value, 10)", "SELECT event_id, abs(value - 50) AS a, round(sqrt(value), 4) AS b, floor(value) AS c, ceil(value) AS d, round(log10(value + 1), 6) AS e, pow(value, 2) AS f, sign(value - 50)::DOUBLE AS g, value % 7 AS h, round(exp(value / 1000), 6) AS i, least(value, 10) AS j, greatest(value, 10) AS k FROM events"),
    "fn_cond": ("events", 'project event_id, a = iff(value > 50, "high", "low"), b = case(value < 10, 1, value < 50, 2, 3), c = coalesce(event_type, "none"), d = isnull(props), e = isnotempty(event_type)', "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS a, CASE WHEN value < 10 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END::BIGINT AS b, coalesce(event_type, 'none') AS c, props IS NULL AS d, coalesce(event_type, '') <> '' AS e FROM events"),
    "fn_datetime": ("events", 'project event_id, a = getyear(ts), b = getmonth(ts), c = dayofmonth(ts), d = dayofweek(ts), e = hourofday(ts), f = dayofyear(ts), g = startofday(ts), h = startofhour(ts), i = format_datetime(ts, "yyyy-MM-dd HH:mm"), j = datetime_part("minute", ts)', "SELECT event_id, year(ts) AS a, month(ts) AS b, day(ts) AS c, dayofweek(ts) AS d, hour(ts) AS e, dayofyear(ts) AS f, date_trunc('day', ts)::TIMESTAMP AS g, date_trunc('hour', ts) AS h, strftime(ts, '%Y-%m-%d %H:%M') AS i, minute(ts) AS j FROM events"),
    "fn_datetime_math": ("events", 'project event_id, a = ts + 90m, b = datetime_add("day", 3, ts), c = datetime_diff("hour", todatetime("2024-03-01"), ts), d = datetime_add("month", 1, todatetime("2024-01-31"))', "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts + INTERVAL 3 DAY AS b, ((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) // 3600000000)::BIGINT AS c, TIMESTAMP '2024-03-02' AS d FROM events"),
    "fn_type": ("events", 'project event_id, a = tolong(value), b = tostring(user_id), c = todouble("12.5"), d = tobool(value), e = gettype(event_type), f = todouble("x1")', "SELECT event_id, trunc(value)::BIGINT AS a, user_id::VARCHAR AS b, 12.5::DOUBLE AS c, value <> 0 AS d, 'string' AS e, NULL::DOUBLE AS f FROM events"),
    "fn_array": ("embeddings", "project vec_id, n = array_length(embedding), first = embedding[0], none = embedding[999]", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[1000] AS none FROM embeddings"),
    "sql_groupby_having": ("", "SELECT l_returnflag AS flag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag HAVING COUNT(*) > 10 ORDER BY n DESC", "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY 1 HAVING count(*) > 10"),
    "sql_join": ("", "SELECT c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000 AND n.n_regionkey IN (1, 2)", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_regionkey IN (1, 2)"),
    "sql_like": ("", "SELECT p_partkey, UPPER(p_type) AS t FROM part WHERE p_name LIKE '%RING' AND p_brand NOT LIKE 'x%'", "SELECT p_partkey, upper(p_type) AS t FROM part WHERE p_name ILIKE '%ring' AND p_brand NOT ILIKE 'x%'"),
    "sql_distinct_order_limit": ("", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_orderpriority LIMIT 3", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY 1 LIMIT 3"),
    "sql_scalar_over_agg": ("", "SELECT event_type, ROUND(AVG(value), 2) AS mean, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY 2", "SELECT event_type, round(avg(value), 2) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "fn_url": ("part", "project p_partkey, a = url_encode(p_name), b = url_decode(url_encode(p_name)), c = url_decode(\"a%2Fb\")", "SELECT p_partkey, replace(p_name, ' ', '+') AS a, p_name AS b, 'a/b' AS c FROM part"),
    "fn_timespan": ("events", 'project event_id, a = totimespan("90m") == 90m, b = ts + totimespan("1h")', "SELECT event_id, true AS a, ts + INTERVAL 1 HOUR AS b FROM events"),
    "fn_finite": ("events", "project event_id, a = isnan(value), b = isfinite(value), c = isfinite(value / 0)", "SELECT event_id, isnan(value) AS a, isfinite(value) AS b, false AS c FROM events"),
    "fn_now": ("events", "where ts < now() and now() > ago(1d) | project event_id, late = ts > ago(1h), soon = ts > now(1h)", "SELECT event_id, false AS late, false AS soon FROM events"),
    "fn_day_edges": ("events", "project event_id, a = endofday(ts), b = startofminute(ts)", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS a, date_trunc('minute', ts) AS b FROM events"),
    "fn_pack_array": ("events", "extend xs = pack_array(value, user_id, 7) | project event_id, n = array_length(xs), first = xs[0], last = xs[2]", "SELECT event_id, 3::BIGINT AS n, value AS first, 7.0::DOUBLE AS last FROM events"),
    "fn_log": ("events", "project event_id, a = round(ln(value + 1), 6), b = round(log2(value + 1), 6), c = round(log(value + 1), 6)", "SELECT event_id, round(ln(value + 1), 6) AS a, round(log2(value + 1), 6) AS b, round(ln(value + 1), 6) AS c FROM events"),
    "fn_trim": ("part", 'extend t = strcat("  ", p_name, " ") | project p_partkey, a = trim(t), b = strlen(trim_start(t)), c = strlen(trim_end(t)), d = tolower(toupper(p_name))', "SELECT p_partkey, p_name AS a, length(p_name) + 1 AS b, length(p_name) + 2 AS c, p_name AS d FROM part"),
    "agg_arg_star": ("orders", "summarize arg_max(o_totalprice, *) by o_orderstatus | project o_orderstatus, o_totalprice, o_orderkey, o_custkey", "SELECT o_orderstatus, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, o_totalprice) AS o_orderkey, arg_max(o_custkey, o_totalprice) AS o_custkey FROM orders GROUP BY 1"),
    "sql_left_join": ("", "SELECT n.n_name, s.s_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey"),
    "sql_right_join": ("", "SELECT s.s_name, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey", "SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "sql_full_join": ("", "SELECT s.s_name, n.n_name FROM supplier s FULL JOIN nation n ON s.s_suppkey = n.n_nationkey", "SELECT s_name, n_name FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey"),
    "sql_cast": ("", "SELECT event_id, CAST(value AS INT) AS a, CAST(user_id AS TEXT) AS b, CAST('2.5' AS DOUBLE) AS c, CAST(value AS BOOLEAN) AS d, CAST('x' AS INT) AS e FROM events", "SELECT event_id, trunc(value)::BIGINT AS a, user_id::VARCHAR AS b, 2.5::DOUBLE AS c, value <> 0 AS d, NULL::BIGINT AS e FROM events"),
    "sql_names": ("", "SELECT event_type, COUNT(*), SUM(value), MAX(user_id) FROM events GROUP BY event_type", "SELECT event_type, count(*) AS count, sum(value) AS sum_value, max(user_id) AS max_user_id FROM events GROUP BY 1"),
    "sql_offset": ("", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3", "SELECT n_nationkey, n_name FROM nation ORDER BY 1 LIMIT 5 OFFSET 3"),
    "sql_functions": ("", "SELECT p_partkey, LENGTH(p_name) AS a, SUBSTR(p_name, 0, 3) AS b, CONCAT(p_brand, '-', p_type) AS c, IFNULL(p_name, 'x') AS d, LOWER(UPPER(p_type)) AS e, CEIL(p_retailprice) AS f, REPLACE(p_name, ' ', '_') AS g FROM part WHERE p_name IS NOT NULL", "SELECT p_partkey, length(p_name) AS a, substr(p_name, 1, 3) AS b, p_brand || '-' || p_type AS c, p_name AS d, lower(p_type) AS e, ceil(p_retailprice) AS f, replace(p_name, ' ', '_') AS g FROM part"),
    "render_rows": ("events", "summarize n = count() by event_type | render barchart with (title=\"kinds\")", "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "render_table": ("nation", "render table", "SELECT * FROM nation"),
    "tpch_q1": ("lineitem", "where l_shipdate <= todatetime(\"1998-09-02\") | summarize sum_qty = sum(l_quantity), sum_price = sum(l_extendedprice), sum_disc = sum(l_extendedprice * (1 - l_discount)), avg_disc = avg(l_discount), n = count() by l_returnflag, l_linestatus | extend sum_qty = round(sum_qty, 2), sum_price = round(sum_price, 2), sum_disc = round(sum_disc, 2), avg_disc = round(avg_disc, 6)", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q3": ("lineitem", 'join (orders | join (customer | where c_mktsegment == "BUILDING") on o_custkey == c_custkey | project o_orderkey, o_orderdate) on l_orderkey == o_orderkey | summarize revenue = sum(l_extendedprice * (1 - l_discount)) by l_orderkey | extend revenue = round(revenue, 2) | top 10 by revenue, l_orderkey asc', "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "tpch_q5": ("orders", "lookup kind=inner (customer | project c_custkey, c_nationkey) on o_custkey == c_custkey | lookup kind=inner (nation | project n_nationkey, n_name) on c_nationkey == n_nationkey | summarize total = sum(o_totalprice) by n_name | extend total = round(total, 2)", "SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "tpch_q6": ("lineitem", "where l_discount between (0.05 .. 0.07) and l_quantity < 24 | summarize revenue = sum(l_extendedprice * l_discount) | extend revenue = round(revenue, 2)", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
}

FLAGSHIP = "where value > 50 | summarize n = count(), mean = avg(value) by event_type | sort by n desc"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, folder=sf_dir)


def _pipeline(table: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).run(query, table or None).df


def agg_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).run("sort by n_nationkey asc | summarize l = make_list(n_name), s = make_set(n_regionkey), a = any(n_name) by n_regionkey", "nation").df
    return df.select("n_regionkey", F.array_join("l", ",").alias("l"), F.size("s").alias("s"), "a")


def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("sample 7", "nation").df


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).context("where value > 200", "events", before=2, after=1, order="event_id")
    return out.select("event_id", F.col("_m").alias("mark"), F.col("_group").cast("long").alias("grp"))


def context_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).context("where value > 200", "events", span_us=60_000_000, order="event_id")
    return out.select("event_id", F.col("_m").alias("mark"))


def histogram_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(engine(spark, sf_dir).table("events"), "value", 10).select("bin", "n")


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine(spark, sf_dir).table("events").withColumn("p", F.from_json("props", "k double"))
    return Engine(spark, {"e": events}).run("summarize n = count(), total = sum(p.k) by event_type", "e").df


def index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine(spark, sf_dir).table("events").withColumn("m", F.from_json("props", "map<string,double>"))
    return Engine(spark, {"e": events}).run('project event_id, k = m["k"], none = m["none"]', "e").df


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cli import time_filter

    return engine(spark, sf_dir).run(time_filter("2024-01-05", "2024-01-09T12:00:00Z", "ts") + " | project event_id, ts", "events").df


def sql_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language named, as the command line's --lang does."""
    return engine(spark, sf_dir).run("select count(*) as n from events where value > 10", None, sql=True).df


_NEAR = "(SELECT event_id AS a FROM events WHERE value > 200)"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "agg_lists": (agg_lists, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS l, 1 AS s, arg_min(n_name, n_nationkey) AS a FROM nation GROUP BY 1"),
    "sample_n": (sample_n, None),
    "context_lines": (
        context_lines,
        f"""WITH o AS (SELECT event_id, value > 200 AS hit, row_number() OVER (ORDER BY event_id) AS r FROM events),
        n AS (SELECT event_id, hit, r FROM o WHERE EXISTS (SELECT 1 FROM o h WHERE h.hit AND o.r BETWEEN h.r - 2 AND h.r + 1)),
        g AS (SELECT *, r - row_number() OVER (ORDER BY r) AS i FROM n)
        SELECT event_id, CASE WHEN hit THEN '>' ELSE '' END AS mark, dense_rank() OVER (ORDER BY i) AS grp FROM g""",
    ),
    "context_time": (context_time, "SELECT DISTINCT e.event_id, CASE WHEN e.value > 200 THEN '>' ELSE '' END AS mark FROM events e JOIN (SELECT ts FROM events WHERE value > 200) h ON e.ts BETWEEN h.ts - INTERVAL 60 SECOND AND h.ts + INTERVAL 60 SECOND"),
    "histogram": (histogram_value, "WITH m AS (SELECT min(value) lo, max(value) hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin FROM events, m) SELECT b::INTEGER AS bin, count(c.bin) AS n FROM range(10) r(b) LEFT JOIN c ON c.bin = b GROUP BY 1"),
    "index_map": (index_map, "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, NULL::DOUBLE AS none FROM events"),
    "time_range": (time_range, "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00'"),
    "sql_by_name": (sql_by_name, "SELECT count(*) AS n FROM events WHERE value > 10"),
    "json_nested": (json_nested, "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::DOUBLE) AS total FROM events GROUP BY 1"),
}


OTHERS |= FORMATS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _pipeline(t, p) for n, (t, p, _) in PIPELINES.items()} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, _, s) in PIPELINES.items()} | {n: s for n, (_, s) in OTHERS.items() if s}
