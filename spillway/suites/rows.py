"""Stateless operators: filter, projection, expressions, columns, unnest, union, route."""

from __future__ import annotations

from ..functions import Dialect
from ..operators import stateless
from ..plans import nodes as n
from ..schema import Field, Schema
from ..sources import external, generated
from .base import frame, query, source


@query("SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_and(d):
    return source(d, "lineitem").filter("l_quantity > 30 AND l_returnflag = 'R'")


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS maybe FROM nation WHERE CASE WHEN n_regionkey > 1 THEN n_regionkey END > 2")
def filter_null(d):
    maybe = {"n_nationkey": "n_nationkey", "maybe": "CASE WHEN n_regionkey > 1 THEN n_regionkey END"}
    return source(d, "nation").map(maybe).filter("maybe > 2")


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND (o_orderstatus = 'F' OR NOT o_totalprice < 100000)")
def filter_or_not(d):
    return source(d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND (o_orderstatus = 'F' OR NOT o_totalprice < 100000)")


@query("""SELECT upper(p_brand) AS brand, p_partkey + p_size * 2 AS calc, lower(p_type) AS kind, p_brand || ' ' || p_type AS label,
  -p_size AS negative, coalesce(CASE WHEN p_size > 25 THEN p_size END, -1) AS or_default, round(p_retailprice * 1.1, 4) AS price,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
  CASE WHEN p_size = 1 THEN 'one' END IS NULL AS unknown FROM part""")
def map_exprs(d):
    return source(d, "part").map({
        "price": "round(p_retailprice * 1.1, 4)",
        "label": "CONCAT(p_brand, ' ', p_type)",
        "brand": "UPPER(p_brand)",
        "kind": "LOWER(p_type)",
        "calc": "p_partkey + p_size * 2",
        "negative": "-p_size",
        "or_default": "COALESCE(CASE WHEN p_size > 25 THEN p_size END, -1)",
        "size_class": "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END",
        "unknown": "CASE WHEN p_size = 1 THEN 'one' END IS NULL",
    })


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'https?://([^/]+\\.org)') THEN regexp_extract(url, 'https?://([^/]+\\.org)', 1) END AS host FROM pages")
def regexp_extract_null(d):
    return source(d, "pages").map({"page_id": "page_id", "host": r"REGEXP_EXTRACT(url, r'https?://([^/]+\.org)', 1)"})


@query("SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS trimmed FROM (SELECT doc_id, ' ' || chr(9) || lang || chr(10) || ' ' AS t FROM documents)")
def trim_ws(d):
    return source(d, "documents").map({"doc_id": "doc_id", "trimmed": "TRIM(concat(' ', char(9), lang, char(10), ' '))"})


@query("SELECT p_partkey, substr(p_name, 1, 4) AS a, substr(p_name, 3, 5) AS b, substr(p_name, 3) AS c FROM part")
def substring_compat(d):
    return source(d, "part").map({"p_partkey": "p_partkey", "a": "SUBSTRING(p_name, -2, 4)", "b": "SUBSTR(p_name, 3, 5)", "c": "SUBSTRING(p_name, 3)"})


@query("SELECT l_orderkey, l_linenumber, l_orderkey // l_linenumber AS q, l_partkey % 7 AS r, l_extendedprice / 2 AS half FROM lineitem", Dialect(integer_division=True))
def int_div(d):
    return source(d, "lineitem").map({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "q": "l_orderkey / l_linenumber", "r": "l_partkey % 7", "half": "l_extendedprice / 2"})


@query("SELECT n_name AS n_nationkey, n_nationkey AS n_name, n_regionkey AS region FROM nation")
def rename_swap(d):
    return source(d, "nation").via(n.Rename(columns={"n_name": "n_nationkey", "n_nationkey": "n_name", "n_regionkey": "region", "nothing": "x"}))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def drop_cols(d):
    return source(d, "supplier").via(n.Drop(columns=("s_name", "s_acctbal", "nothing")))


@query("SELECT s_acctbal, s_suppkey FROM supplier")
def project_cols(d):
    return source(d, "supplier").via(n.Project(columns=("s_acctbal", "s_suppkey")))


@query("SELECT *, s_acctbal > 0 AS positive, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def add_field(d):
    return source(d, "supplier").via(n.AddField(columns={"positive": "s_acctbal > 0", "nation": "s_nationkey"}, types={"nation": Field.BIGINT()}))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 150000 THEN o_orderpriority END, 'none: ' || o_orderstatus) AS p, o_orderstatus FROM orders")
def coalesce_default(d):
    some = {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "p": "CASE WHEN o_totalprice > 150000 THEN o_orderpriority END"}
    return source(d, "orders").map(some).via(n.Coalesce(columns={"p": "CONCAT('none: ', o_orderstatus)"}))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, TRY_CAST(o_orderstatus AS BIGINT) AS o_orderstatus FROM orders")
def cast_types(d):
    few = source(d, "orders").via(n.Project(columns=("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")))
    return few.via(n.Cast(columns={"o_orderkey": Field.STRING(), "o_totalprice": Field.BIGINT(), "o_custkey": Field.DOUBLE(), "o_orderstatus": Field.BIGINT()}, on_error="null"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flatmap_unnest(d):
    return source(d, "part").map({"p_partkey": "p_partkey", "words": "split(p_name, ' ')"}).via(n.FlatMap(unnest="words", into={"word": Field.STRING()}))


@query("SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def flatmap_list(d):
    return source(d, "embeddings").via(n.FlatMap(unnest="embedding", into={"x": Field.DOUBLE()}))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events WHERE user_id < 20")
def union_all(d):
    few = {"event_id": "event_id", "user_id": "user_id"}
    left = source(d, "events").filter("event_type = 'view'").map(few)
    right = source(d, "events").filter("user_id < 20").map(few).via(n.Project(columns=("user_id", "event_id")))
    return n.Union(inputs=(left, right))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events")
def union_all_whole(d):
    few = {"event_id": "event_id", "user_id": "user_id"}
    left = source(d, "events").filter("event_type = 'view'").map(few)
    return n.Union(inputs=(left, source(d, "events").map(few).via(n.Project(columns=("user_id", "event_id")))))


SETS = {k: f"SELECT c_nationkey AS k FROM customer {k} SELECT s_nationkey AS k FROM supplier" for k in ("INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL", "UNION")}


def of_both(d, text):
    return n.RawSQL(sql=text, inputs=(source(d, "customer"), source(d, "supplier")))


@query(SETS["INTERSECT"])
def set_intersect(d):
    return of_both(d, SETS["INTERSECT"])


@query(SETS["INTERSECT ALL"])
def set_intersect_all(d):
    return of_both(d, SETS["INTERSECT ALL"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id AS k FROM events")
def set_except(d):
    return n.RawSQL(sql="SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id AS k FROM events", inputs=(source(d, "customer"), source(d, "events")))


@query(SETS["EXCEPT ALL"])
def set_except_all(d):
    return of_both(d, SETS["EXCEPT ALL"])


@query(SETS["UNION"])
def set_union(d):
    return of_both(d, SETS["UNION"])


@query("SELECT CASE WHEN value > 50 THEN 'high' WHEN event_type = 'view' THEN 'views' ELSE 'rest' END AS route, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def route_first_match(spark, d):
    route = source(d, "events").via(n.Route(branches=(n.Branch("high", "value > 50"), n.Branch("views", "event_type = 'view'"))))
    parts = [o.map({"event_id": "event_id", "route": f"'{name}'"}) for name, o in (("high", route.branch("high")), ("views", route.branch("views")), ("rest", route.default()))]
    return frame(spark, n.Union(inputs=tuple(parts)).aggregate(["route"], {"n": "count(*)", "ids": "sum(event_id)"}))


@query("SELECT i AS id, i * CAST(1.1 AS DOUBLE) AS value, 'label_' || i AS label, i % 2 = 0 AS flag FROM range(1000) t(i)")
def generator_source(d):
    return n.GeneratorSource(schema=Schema({"id": Field.BIGINT(), "value": Field.DOUBLE(), "label": Field.STRING(), "flag": Field.BOOLEAN()}), max_rows=1000)


@query("SELECT event_id, user_id, event_type FROM events")
def topic_codec(spark, d):
    """Rows as a topic's records and back."""
    schema = Schema({"event_id": Field.BIGINT(), "user_id": Field.BIGINT(), "event_type": Field.STRING()})
    rows = frame(spark, source(d, "events").via(n.Project(columns=tuple(schema.fields))))
    return external.decode(external.encode(rows, ["user_id"]), schema)


@query("SELECT CAST(user_id AS VARCHAR) AS k, event_id, CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT) AS prop FROM events")
def topic_json(spark, d):
    """A topic's JSON values with a number where a string is declared."""
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("""concat('{"k":', user_id, ',"event_id":', event_id, ',"props":', props, '}') AS value""")
    out = external.decode(rows, Schema({"k": Field.STRING(), "event_id": Field.BIGINT(), "props": Field.ROW({"k": Field.BIGINT()})}))
    return out.selectExpr("k", "event_id", "props.k AS prop")


@query(None)
def ad_events(spark, d):
    return stateless.where(generated.ad_events(spark, 10_000), "event_type = 'view'")
