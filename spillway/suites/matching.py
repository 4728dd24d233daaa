"""Row patterns, and worked pipelines that chain several operators."""

from __future__ import annotations

from ..plans import nodes as n
from ..schema import Field
from .base import query, source


@query("""SELECT user_id, a AS first_id, c AS last_id FROM (SELECT user_id, event_id AS a, event_type AS t1, lead(event_type) OVER w AS t2, lead(event_type, 2) OVER w AS t3, lead(event_id, 2) OVER w AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE t1 = 'view' AND t2 = 'click' AND t3 = 'purchase'""")
def match_recognize_abc(d):
    kinds = {v: f"event_type = '{k}'" for v, k in (("A", "view"), ("B", "click"), ("C", "purchase"))}
    return source(d, "events").via(n.MatchRecognize(pattern="A B C", define=kinds, measures={"first_id": "A.event_id", "last_id": "C.event_id"}, partition_by=("user_id",), order_by="ts"))


@query("""SELECT user_id, min(event_id) AS first_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts) AS g
  FROM events) WHERE event_type = 'view' GROUP BY user_id, g HAVING count(*) >= 2""")
def match_recognize_runs(d):
    """Runs of two or more views."""
    found = source(d, "events").via(n.MatchRecognize(pattern="A{2,}", define={"A": "event_type = 'view'"}, measures={"first_id": "FIRST(A.event_id)", "n": "COUNT(A.event_id)", "total": "SUM(A.value)", "top": "MAX(A.value)"}, partition_by=("user_id",), order_by="ts"))
    return found.map({"user_id": "user_id", "first_id": "first_id", "n": "n", "total": "round(total, 2)", "top": "top"})


@query("""SELECT user_id, event_id AS low_id, value AS low, before FROM (SELECT *, lag(value) OVER w AS before, lead(value) OVER w AS after, lag(value, 2) OVER w AS x
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE value < before AND after > value""")
def match_recognize_dips(d):
    """A lower value between higher ones; each may begin at the row after the last one's beginning."""
    return source(d, "events").via(n.MatchRecognize(pattern="A B C", define={"B": "value < A.value", "C": "value > B.value"}, measures={"low_id": "B.event_id", "low": "B.value", "before": "A.value"}, partition_by=("user_id",), order_by="ts", after="NEXT_ROW"))


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, round(sum(value), 2) AS revenue
  FROM events WHERE event_type = 'purchase' AND value > 5 GROUP BY ALL HAVING sum(value) > 50""")
def worked_revenue(d):
    spent = source(d, "events").filter("event_type = 'purchase' AND value > 5").tumble("1 DAY", "ts").aggregate(["user_id"], {"revenue": "SUM(value)"})
    return spent.filter("revenue > 50").map({"user_id": "user_id", "window_start": "window_start", "window_end": "window_end", "revenue": "round(revenue, 2)"})


@query("""SELECT upper(event_type) AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id FROM events WHERE value > 20""")
def worked_etl(d):
    rows = source(d, "events").filter("value > 20").map({"event_id": "event_id", "kind": "UPPER(event_type)", "raw": "get_json_object(props, '$.k')"})
    return rows.via(n.Rename(columns={"raw": "k"})).via(n.Cast(columns={"k": Field.BIGINT()}))


@query("""SELECT user_id, count(*) AS actions, string_agg(event_type, ',' ORDER BY ts) AS path, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, CAST(datediff('second', min(ts), max(ts)) AS BIGINT) AS seconds
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s HAVING count(*) > 1""")
def worked_sessions(d):
    made = {"actions": "COUNT(*)", "path": "LISTAGG(event_type, ',') WITHIN GROUP (ORDER BY ts)", "seconds": "unix_seconds(CAST(MAX(ts) AS TIMESTAMP)) - unix_seconds(CAST(MIN(ts) AS TIMESTAMP))"}
    return source(d, "events").session("6 hours", "ts").aggregate(["user_id"], made).filter("actions > 1")


@query("""SELECT event_type, window_start, user_id, total FROM (SELECT *, row_number() OVER (PARTITION BY event_type, window_start ORDER BY total DESC, user_id) AS rn FROM (
  SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, user_id, round(sum(value), 2) AS total FROM events GROUP BY ALL)) WHERE rn <= 2""")
def worked_leaders(d):
    totals = source(d, "events").tumble("7 DAY", "ts").aggregate(["event_type", "user_id"], {"total": "round(SUM(value), 2)"})
    return totals.via(n.TopN(partition_by=("event_type", "window_start"), order_by={"total": "DESC", "user_id": "ASC"}, n=2)).via(n.Project(columns=("event_type", "window_start", "user_id", "total")))
