"""Grouping, windows over event time, deduplication, top-n, analytic functions, SQL."""

from __future__ import annotations

from ..operators.sql import Call, WindowSpec
from ..plans import nodes as n
from ..schema import Field, Schema
from .base import query, source

BUCKET = "time_bucket(INTERVAL {}, ts, TIMESTAMP '1970-01-01')"


@query(f"SELECT user_id, {BUCKET.format('1 HOUR')} AS window_start, {BUCKET.format('1 HOUR')} + INTERVAL 1 HOUR AS window_end, count(*) AS view_count FROM events WHERE event_type = 'view' GROUP BY ALL")
def views_per_hour(d):
    """The flagship: filter, project, tumble, count."""
    return source(d, "events").filter("event_type = 'view'").map({"user_id": "user_id", "ts": "ts"}).tumble("1 hour", "ts").aggregate(["user_id"], {"view_count": "COUNT(*)"})


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY ALL")
def agg_group(d):
    return source(d, "lineitem").aggregate(["l_returnflag", "l_linestatus"], {"l_returnflag": "l_returnflag", "qty": "round(SUM(l_quantity), 2)", "n": "COUNT(*)", "disc": "round(AVG(l_discount), 6)", "lo": "MIN(l_tax)", "hi": "MAX(l_tax)"})


@query("SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def agg_global(d):
    return source(d, "events").aggregate([], {"n": "COUNT(*)", "total": "round(SUM(value), 2)"})


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_distinct(d):
    return source(d, "events").aggregate(["event_type"], {"users": "COUNT(DISTINCT user_id)"})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60 AND avg(value) > 40")
def agg_having(d):
    return source(d, "events").via(n.Query(select={"user_id": "user_id", "n": "COUNT(*)"}, group_by=("user_id",), having="count(*) > 60 AND avg(value) > 40"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def listagg(d):
    return source(d, "events").aggregate(["user_id"], {"kinds": "LISTAGG(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type)"})


@query("SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.5), 4) AS p50 FROM events GROUP BY 1")
def percentile_cont(d):
    return source(d, "events").aggregate(["event_type"], {"p95": "round(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY value), 4)", "p50": "round(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 4)"})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(d):
    return source(d, "lineitem").sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM input GROUP BY ROLLUP (l_returnflag, l_linestatus)")


GROUPING = "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, grouping({0}) AS whole FROM {1} GROUP BY {2}"


@query(GROUPING.format("l_linestatus", "lineitem", "GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus, l_linenumber), ())"))
def grouping_sets(d):
    return source(d, "lineitem").sql(GROUPING.format("l_linestatus", "input", "GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus, l_linenumber), ())"))


@query(GROUPING.format("l_linenumber", "lineitem", "CUBE (l_returnflag, l_linestatus, l_linenumber)"))
def cube(d):
    return source(d, "lineitem").sql(GROUPING.format("l_linenumber", "input", "CUBE (l_returnflag, l_linestatus, l_linenumber)"))


@query(f"SELECT event_type, {BUCKET.format('7 DAY')} AS window_start, {BUCKET.format('7 DAY')} + INTERVAL 7 DAY AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumble_week(d):
    return source(d, "events").tumble("7 DAY", "ts").aggregate(["event_type"], {"n": "COUNT(*)", "total": "round(SUM(value), 2)"})


@query("""SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, round(sum(value), 2) AS total, count(*) AS n FROM (
  SELECT value, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(3 * k AS INTEGER)) AS w FROM events, range(2) r(k)) GROUP BY 1""")
def slide_sum(d):
    return source(d, "events").slide("6 hours", "3 hours", "ts").aggregate([], {"total": "round(SUM(value), 2)", "n": "COUNT(*)"})


SESSIONS = """SELECT user_id, ts, value, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)"""


@query(f"SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM ({SESSIONS}) GROUP BY user_id, s")
def session_agg(d):
    return source(d, "events").session("6 hours", "ts").aggregate(["user_id"], {"n": "COUNT(*)", "total": "round(SUM(value), 2)"})


@query(f"SELECT event_id, user_id, min(ts) OVER w AS window_start, max(ts) OVER w + INTERVAL 6 HOUR AS window_end FROM ({SESSIONS}) WINDOW w AS (PARTITION BY user_id, s)")
def session_rows(d):
    return source(d, "events").session("6 hours", "ts", key=("user_id",)).via(n.Project(columns=("event_id", "user_id", "ts"))).sql("SELECT event_id, user_id, window_start, window_end FROM input")


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) AS rn FROM (SELECT user_id, {BUCKET.format('1 DAY')} AS window_start, {BUCKET.format('1 DAY')} + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL)) WHERE rn <= 3")
def tumble_topn(d):
    counts = source(d, "events").tumble("1 DAY", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})
    return counts.via(n.TopN(partition_by=("window_start",), order_by={"n": "DESC", "user_id": "ASC"}, n=3))


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_type, window_start ORDER BY value DESC, event_id) AS rn FROM (SELECT *, {BUCKET.format('7 DAY')} AS window_start, {BUCKET.format('7 DAY')} + INTERVAL 7 DAY AS window_end FROM events)) WHERE rn <= 2")
def topn_in_window(d):
    return source(d, "events").tumble("7 DAY", "ts").via(n.TopN(partition_by=("event_type",), order_by={"value": "DESC", "event_id": "ASC"}, n=2))


@query("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events) WHERE rn = 1")
def dedup_first(d):
    return source(d, "events").via(n.Deduplicate(key=("user_id",), order="ts"))


@query("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1")
def dedup_last(d):
    return source(d, "events").via(n.Deduplicate(key=("user_id", "event_type"), order="ts", keep="last"))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def topn_per_key(d):
    return source(d, "lineitem").via(n.TopN(partition_by=("l_suppkey",), order_by={"l_extendedprice": "DESC", "l_orderkey": "ASC", "l_linenumber": "ASC"}, n=3, rank_column="rn"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(d):
    return source(d, "orders").via(n.OrderBy(columns={"o_totalprice": "DESC", "o_orderkey": "ASC"})).via(n.Limit(n=25))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, lag(o_orderkey) OVER w AS before,
  lead(o_orderkey, 2) OVER w AS after, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rank_lag_lead(d):
    by = {"o_orderdate": "ASC", "o_orderkey": "ASC"}
    return source(d, "orders").via(n.Query(
        select={
            "o_custkey": "o_custkey",
            "o_orderkey": "o_orderkey",
            "rn": Call("row_number", window="w"),
            "rk": Call("rank", over=WindowSpec(("o_custkey",), {"o_orderstatus": "ASC"})),
            "before": Call("lag", ("o_orderkey",), window="w"),
            "after": Call("lead", ("o_orderkey", "2"), window="w"),
            "moving": Call("sum", ("o_totalprice",), over=WindowSpec(("o_custkey",), by, rows=(-2, 0))),
        },
        windows={"w": WindowSpec(("o_custkey",), by)},
    )).sql("SELECT * EXCEPT (moving), round(moving, 2) AS moving FROM input")


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 5 ORDER BY 1")
def query_component(d):
    return source(d, "orders").via(n.Query(select={"priority": "o_orderpriority", "n": "COUNT(*)", "total": "round(SUM(o_totalprice), 2)"}, where="o_orderstatus = 'O'", group_by=("o_orderpriority",), having="n > 5", order_by={"priority": "ASC"}))


@query("SELECT user_id, count(*) AS readings, round(avg(value), 4) AS mean FROM events GROUP BY 1 HAVING avg(value) > 45")
def raw_sql(d):
    out = Schema({"user_id": Field.BIGINT(), "readings": Field.BIGINT(), "mean": Field.DOUBLE()})
    return source(d, "events").sql("SELECT user_id, count(*) AS readings, round(avg(value), 4) AS mean FROM input GROUP BY user_id HAVING avg(value) > 45", output_schema=out)


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def subqueries(d):
    text = "SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"
    return n.RawSQL(sql=text, inputs=(source(d, "customer"), source(d, "orders"), source(d, "nation")))


@query("SELECT * EXCLUDE (rn) FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 2")
def qualify(d):
    return source(d, "events").sql("SELECT user_id, event_id, value FROM input QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")


@query(f"SELECT {BUCKET.format('1 DAY')} AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def sql_tumble(d):
    return source(d, "events").sql("SELECT TUMBLE_START(ts, INTERVAL '1' DAY) AS day, event_type, count(*) AS n FROM input GROUP BY TUMBLE(ts, INTERVAL '1' DAY), event_type")


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(3 * k AS INTEGER)) AS w FROM events, range(2) r(k)) GROUP BY 1""")
def sql_hop(d):
    return source(d, "events").sql("SELECT HOP_START(ts, INTERVAL '3' HOUR, INTERVAL '6' HOUR) AS window_start, count(*) AS n FROM input GROUP BY HOP(ts, INTERVAL '3' HOUR, INTERVAL '6' HOUR)")


@query(f"SELECT user_id, min(ts) AS began, count(*) AS n FROM ({SESSIONS}) GROUP BY user_id, s")
def sql_session(d):
    return source(d, "events").sql("SELECT user_id, SESSION_START(ts, INTERVAL '6' HOUR) AS began, count(*) AS n FROM input GROUP BY user_id, SESSION(ts, INTERVAL '6' HOUR)")


@query("SELECT date_trunc('month', o_orderdate) AS m, CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS days, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, regexp_replace(min(o_orderpriority), '[0-9]-', '', 'g') AS p FROM orders GROUP BY 1")
def sql_functions(d):
    return source(d, "orders").sql("SELECT m, TIMESTAMPDIFF(DAY, a, b) AS days, states, p FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, min(o_orderdate) AS a, max(o_orderdate) AS b, array_join(array_sort(array_agg(DISTINCT o_orderstatus)), ',') AS states, regexp_replace(min(o_orderpriority), '[0-9]-', '') AS p FROM input GROUP BY 1)")
