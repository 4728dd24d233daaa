"""The queries of the online-auction benchmark, with events for bids, customers for persons, orders for auctions."""

from __future__ import annotations

from ..operators import grouping
from ..plans import nodes as n
from ..sources import generated
from .base import frame, query, source

DAY = "time_bucket(INTERVAL {}, ts, TIMESTAMP '1970-01-01')"


@query("SELECT * FROM events")
def auction_q0(d):
    return source(d, "events").filter("true")


@query("SELECT event_id, user_id, value * 0.908::DOUBLE AS price FROM events")
def auction_q1(d):
    return source(d, "events").map({"event_id": "event_id", "user_id": "user_id", "price": "value * 0.908"})


@query("SELECT event_id, value FROM events WHERE user_id % 12 = 0")
def auction_q2(d):
    return source(d, "events").filter("user_id % 12 = 0").map({"event_id": "event_id", "value": "value"})


@query("SELECT c_name, c_nationkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND o_orderpriority = '1-URGENT'")
def auction_q3(d):
    sides = (source(d, "customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"), source(d, "orders").filter("o_orderpriority = '1-URGENT'"))
    return n.Join(inputs=sides, on="l.c_custkey = r.o_custkey").via(n.Project(columns=("c_name", "c_nationkey", "o_orderkey")))


@query("SELECT o_orderpriority, time_bucket(INTERVAL 30 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 30 DAY, o_orderdate, TIMESTAMP '1970-01-01') + INTERVAL 30 DAY AS window_end, round(avg(l_extendedprice) + 0.0000001, 4) AS mean FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def auction_q4(d):
    both = n.Join(inputs=(source(d, "orders"), source(d, "lineitem")), on="l.o_orderkey = r.l_orderkey")
    return both.tumble("30 days", "o_orderdate").aggregate(["o_orderpriority"], {"mean": "round(AVG(l_extendedprice) + 0.0000001, 4)"})


@query("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) AS rn FROM (SELECT user_id, w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM (
  SELECT user_id, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(3 * k AS INTEGER)) AS w FROM events, range(2) r(k)) GROUP BY ALL)) WHERE rn = 1""")
def auction_q5(d):
    counts = source(d, "events").slide("6 hours", "3 hours", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})
    return counts.via(n.TopN(partition_by=("window_start",), order_by={"n": "DESC", "user_id": "ASC"}, n=1))


@query(f"SELECT {DAY.format('1 DAY')} AS window_start, {DAY.format('1 DAY')} + INTERVAL 1 DAY AS window_end, max(value) AS top FROM events GROUP BY ALL")
def auction_q7(d):
    return source(d, "events").tumble("1 day", "ts").aggregate([], {"top": "MAX(value)"})


@query("""SELECT DISTINCT a.user_id, a.w AS window_start FROM (SELECT user_id, date_trunc('day', ts) AS w FROM events WHERE event_type = 'signup') a
  JOIN (SELECT user_id, date_trunc('day', ts) AS w FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.w = b.w""")
def auction_q8(d):
    sides = [source(d, "events").filter(f"event_type = '{k}'").map({"user_id": "user_id", "ts": "ts"}).tumble("1 day", "ts") for k in ("signup", "view")]
    return n.Join(inputs=tuple(sides), on="l.user_id = r.user_id", type="semi").sql("SELECT DISTINCT user_id, window_start FROM input")


@query("SELECT o_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate) WHERE rn = 1")
def auction_q9(d):
    both = n.Join(inputs=(source(d, "orders"), source(d, "lineitem")), on="l.o_orderkey = r.l_orderkey AND r.l_shipdate >= l.o_orderdate")
    return both.via(n.TopN(partition_by=("o_orderkey",), order_by={"l_extendedprice": "DESC", "l_linenumber": "ASC"}, n=1)).via(n.Project(columns=("o_orderkey", "l_partkey", "l_extendedprice")))


@query("""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def auction_q11(d):
    return source(d, "events").session("6 hours", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def auction_q12(spark, d):
    """Windows over the time of processing: a batch is processed at one time, so its rows share one."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("pt", F.current_timestamp())
    return grouping.aggregate(rows, ["user_id"], {"n": "COUNT(*)"}, grouping.Span("tumble", "pt", "10 seconds")).select("user_id", "n")


@query("SELECT e.event_id, e.value, p.p_name FROM events e JOIN part p ON e.user_id = p.p_partkey")
def auction_q13(d):
    """A side input at rest."""
    return source(d, "events").via(n.LookupJoin(table=source(d, "part"), on="l.user_id = r.p_partkey", select=("p_name",), type="inner")).via(n.Project(columns=("event_id", "value", "p_name")))


@query(None)
def auction_generated(spark, d):
    """Persons that sell, by state: generated rows."""
    rows = generated.auction_events(spark, 20_000)
    sides = tuple(n.TableSource(frame=rows[k], name=k) for k in ("person", "auction"))
    both = n.Join(inputs=sides, on="p.id = a.seller", aliases=("p", "a")).filter("state IN ('OR', 'ID', 'CA')")
    return frame(spark, both.aggregate(["state"], {"n": "COUNT(*)"}))
