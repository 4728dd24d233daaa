"""Joins, and decision-support queries over the retail tables."""

from __future__ import annotations

from ..plans import nodes as n
from .base import query, source


def customers(d):
    return source(d, "customer").filter("c_custkey % 3 <> 0")


def big_orders(d):
    return source(d, "orders").filter("o_totalprice > 120000").via(n.Project(columns=("o_orderkey", "o_custkey", "o_totalprice")))


C, O = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0)", "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 120000)"


def joined(d, kind, **more):
    return n.Join(inputs=(customers(d), big_orders(d)), on="l.c_custkey = r.o_custkey", type=kind, **more)


@query(f"SELECT * FROM {C} JOIN {O} ON c_custkey = o_custkey")
def join_inner(d):
    return joined(d, "inner")


@query(f"SELECT * FROM {C} LEFT JOIN {O} ON c_custkey = o_custkey")
def join_left(d):
    return joined(d, "left")


@query(f"SELECT * FROM {C} RIGHT JOIN {O} ON c_custkey = o_custkey")
def join_right(d):
    return joined(d, "right")


@query(f"SELECT * FROM {C} FULL JOIN {O} ON c_custkey = o_custkey")
def join_full(d):
    return joined(d, "full")


@query(f"SELECT * FROM {C} SEMI JOIN {O} ON c_custkey = o_custkey")
def join_semi(d):
    return joined(d, "semi")


@query(f"SELECT * FROM {C} ANTI JOIN {O} ON c_custkey = o_custkey")
def join_anti(d):
    return joined(d, "anti")


def customers_and_events(d, kind):
    """Whole tables; most customers have no events."""
    return n.Join(inputs=(source(d, "customer"), source(d, "events")), on="l.c_custkey = r.user_id", type=kind)


@query("SELECT * FROM customer JOIN events ON c_custkey = user_id")
def join_inner_whole(d):
    return customers_and_events(d, "inner")


@query("SELECT * FROM customer LEFT JOIN events ON c_custkey = user_id")
def join_left_whole(d):
    return customers_and_events(d, "left")


@query("SELECT * FROM customer RIGHT JOIN events ON c_custkey = user_id")
def join_right_whole(d):
    return customers_and_events(d, "right")


@query("SELECT * FROM customer FULL JOIN events ON c_custkey = user_id")
def join_full_whole(d):
    return customers_and_events(d, "full")


@query("SELECT * FROM customer SEMI JOIN events ON c_custkey = user_id")
def join_semi_whole(d):
    return customers_and_events(d, "semi")


@query("SELECT * FROM customer ANTI JOIN events ON c_custkey = user_id")
def join_anti_whole(d):
    return customers_and_events(d, "anti")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(d):
    """Nations and regions are fixed tables of a few rows."""
    nations = n.Join(inputs=(source(d, "nation"), source(d, "region")), on="l.n_regionkey = r.r_regionkey", broadcast="right")
    return n.Join(inputs=(source(d, "supplier"), nations), on="s.s_nationkey = n.n_nationkey", aliases=("s", "n"), broadcast="right").via(n.Project(columns=("s_suppkey", "n_name", "r_name")))


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p ON v.user_id = p.user_id
  AND p.ts BETWEEN v.ts - INTERVAL 1 MINUTE AND v.ts + INTERVAL 5 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def interval_join(d):
    views = source(d, "events").filter("event_type = 'view'").map({"view_id": "event_id", "user_id": "user_id", "ts": "ts"})
    bought = source(d, "events").filter("event_type = 'purchase'").map({"purchase_id": "event_id", "buyer": "user_id", "pts": "ts"})
    both = n.IntervalJoin(inputs=(views, bought), on="l.user_id = r.buyer", left_ts="ts", right_ts="pts", lower="l.ts - INTERVAL '1' MINUTE", upper="5 hours")
    return both.via(n.Project(columns=("view_id", "purchase_id", "user_id")))


BOUNDS = "v.user_id = p.user_id AND p.ts BETWEEN v.ts - INTERVAL 1 MINUTE AND v.ts + INTERVAL 5 HOUR"
SIDES = "(SELECT * FROM events WHERE event_type = 'view') v {} JOIN (SELECT * FROM events WHERE event_type = 'purchase') p"


def views_near_purchases(d, kind):
    views = source(d, "events").filter("event_type = 'view'").map({"view_id": "event_id", "user_id": "user_id", "ts": "ts"})
    bought = source(d, "events").filter("event_type = 'purchase'").map({"purchase_id": "event_id", "buyer": "user_id", "pts": "ts"})
    both = n.IntervalJoin(inputs=(views, bought), on="l.user_id = r.buyer", left_ts="ts", right_ts="pts", lower="-1 MINUTE", upper="5 hours", type=kind)
    return both.via(n.Project(columns=("view_id", "purchase_id")))


@query(f"SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM {SIDES.format('LEFT')} ON {BOUNDS}")
def interval_join_left(d):
    return views_near_purchases(d, "left")


@query(f"SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM {SIDES.format('RIGHT')} ON {BOUNDS}")
def interval_join_right(d):
    return views_near_purchases(d, "right")


@query(f"SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM {SIDES.format('FULL')} ON {BOUNDS}")
def interval_join_full(d):
    return views_near_purchases(d, "full")


def purchases_and_views(d):
    bought = source(d, "events").filter("event_type = 'purchase'").map({"event_id": "event_id", "user_id": "user_id", "ts": "ts"})
    views = source(d, "events").filter("event_type = 'view'").map({"view_id": "event_id", "viewer": "user_id", "vts": "ts", "op": "CASE WHEN value < 10 THEN 'DELETE' ELSE 'INSERT' END"})
    return bought, views


ASOF = """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.user_id AS viewer, v.ts AS vts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF {} JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""


@query(ASOF.format(""))
def temporal_join(d):
    facts, versions = purchases_and_views(d)
    return n.TemporalJoin(inputs=(facts, versions.via(n.Drop(columns=("op",)))), on={"user_id": "viewer"}, as_of="ts", version="vts")


@query(ASOF.format("LEFT"))
def temporal_join_left(d):
    facts, versions = purchases_and_views(d)
    return n.TemporalJoin(inputs=(facts, versions.via(n.Drop(columns=("op",)))), on={"user_id": "viewer"}, as_of="ts", version="vts", type="left")


@query("SELECT * EXCLUDE (value) FROM (" + ASOF.format("").replace("v.ts AS vts", "v.ts AS vts, v.value") + ") WHERE value >= 10")
def temporal_join_changelog(d):
    facts, versions = purchases_and_views(d)
    return n.TemporalJoin(inputs=(facts, versions), on={"user_id": "viewer"}, as_of="ts", version="vts", changelog="op")


@query("SELECT e.*, c.c_name, c.c_mktsegment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def lookup_join(d):
    return source(d, "events").via(n.LookupJoin(table=source(d, "customer"), on="l.user_id = r.c_custkey", select=("c_name", "c_mktsegment")))


@query("""SELECT a.user_id, a.view_id, b.click_id, a.w AS window_start, a.w + INTERVAL 1 HOUR AS window_end
  FROM (SELECT user_id, event_id AS view_id, date_trunc('hour', ts) AS w FROM events WHERE event_type = 'view') a
  JOIN (SELECT user_id, event_id AS click_id, date_trunc('hour', ts) AS w FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.w = b.w""")
def windowed_join(d):
    sides = [source(d, "events").filter(f"event_type = '{k}'").map({"user_id" if k == "view" else "clicker": "user_id", f"{k}_id": "event_id", f"{k}_ts": "ts"}).tumble("1 hour", f"{k}_ts") for k in ("view", "click")]
    return n.Join(inputs=tuple(sides), on="l.user_id = r.clicker").via(n.Project(columns=("user_id", "view_id", "click_id", "window_start", "window_end")))


HOURS = "(SELECT user_id, event_id AS {0}_id, date_trunc('hour', ts) AS w FROM events WHERE event_type = '{0}')"


def views_beside_clicks(d, kind):
    sides = [source(d, "events").filter(f"event_type = '{k}'").map({"user_id" if k == "view" else "clicker": "user_id", f"{k}_id": "event_id", f"{k}_ts": "ts"}).tumble("1 hour", f"{k}_ts") for k in ("view", "click")]
    return n.Join(inputs=tuple(sides), on="l.user_id = r.clicker", type=kind)


@query(f"SELECT view_id, click_id, coalesce(a.w, b.w) AS window_start, coalesce(a.w, b.w) + INTERVAL 1 HOUR AS window_end FROM {HOURS.format('view')} a LEFT JOIN {HOURS.format('click')} b ON a.user_id = b.user_id AND a.w = b.w")
def windowed_join_left(d):
    return views_beside_clicks(d, "left").via(n.Project(columns=("view_id", "click_id", "window_start", "window_end")))


@query(f"SELECT view_id, click_id, coalesce(a.w, b.w) AS window_start, coalesce(a.w, b.w) + INTERVAL 1 HOUR AS window_end FROM {HOURS.format('view')} a FULL JOIN {HOURS.format('click')} b ON a.user_id = b.user_id AND a.w = b.w")
def windowed_join_full(d):
    return views_beside_clicks(d, "full").via(n.Project(columns=("view_id", "click_id", "window_start", "window_end")))


@query(f"SELECT view_id, a.w AS window_start, a.w + INTERVAL 1 HOUR AS window_end FROM {HOURS.format('view')} a ANTI JOIN {HOURS.format('click')} b ON a.user_id = b.user_id AND a.w = b.w")
def windowed_join_anti(d):
    return views_beside_clicks(d, "anti").via(n.Project(columns=("view_id", "window_start", "window_end")))


def over(d, sql, *tables):
    return n.RawSQL(sql=sql, inputs=tuple(source(d, t) for t in tables))


Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= {} GROUP BY l_returnflag, l_linestatus"""
Q3 = """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < {0} AND l_shipdate > {0} GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
Q5 = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' AND o_orderdate >= {} AND o_orderdate < {} GROUP BY n_name"""
Q6 = "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= {} AND l_shipdate < {} AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
Q10 = """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= {} AND o_orderdate < {} AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""


def stamp(day, spark=False):
    return f"TIMESTAMP{'_NTZ' if spark else ''} '{day}'"


@query(Q1.format(stamp("1998-09-02")))
def tpch_q1(d):
    return over(d, Q1.format(stamp("1998-09-02", True)), "lineitem")


@query(Q3.format(stamp("1997-03-15")))
def tpch_q3(d):
    return over(d, Q3.format(stamp("1997-03-15", True)), "customer", "orders", "lineitem")


@query(Q5.format(stamp("1996-01-01"), stamp("1998-01-01")))
def tpch_q5(d):
    return over(d, Q5.format(stamp("1996-01-01", True), stamp("1998-01-01", True)), "customer", "orders", "lineitem", "supplier", "nation", "region")


@query(Q6.format(stamp("1996-01-01"), stamp("1998-01-01")))
def tpch_q6(d):
    return over(d, Q6.format(stamp("1996-01-01", True), stamp("1998-01-01", True)), "lineitem")


@query(Q10.format(stamp("1996-10-01"), stamp("1997-04-01")))
def tpch_q10(d):
    return over(d, Q10.format(stamp("1996-10-01", True), stamp("1997-04-01", True)), "customer", "orders", "lineitem", "nation")
