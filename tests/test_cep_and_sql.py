import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spillway.operators import cep, sql
from spillway.operators.sql import Call, SqlError, WindowSpec


@pytest.fixture(scope="module")
def prices(spark):
    data = [("a", k, p) for k, p in enumerate([10, 12, 9, 7, 8, 11, 11, 5, 6, None, 3])] + [("b", 0, 1), ("b", 1, 2)] + [(None, 0, 3), (None, 1, 2), (None, 2, 5)]
    return spark.createDataFrame(data, "s string, t int, price int")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fall_and_rise(prices):
    out = cep.match_recognize(prices, "A B+ C+", {"B": "price < LAST(B.price, 1) OR COUNT(B.price) = 1 AND price < A.price", "C": "price > PREV(price)"}, {"first": "A.t", "low": "LAST(B.price)", "last": "LAST(C.t)", "n": "COUNT(*)"}, ["s"], "t")
    # with its own row counted, LAST(B.price, 1) is the row before in the run
    assert found(out) == sorted([("a", 1, 7, 5, 5), ("a", 6, 5, 8, 3), (None, 0, 2, 2, 3)], key=str)


def test_after_match(prices):
    define, measures = {"A": "price > 8", "B": "price > 8"}, {"a": "A.t", "b": "B.t"}
    assert found(cep.match_recognize(prices, "A B", define, measures, ["s"], "t")) == [("a", 0, 1), ("a", 5, 6)]
    assert found(cep.match_recognize(prices, "A B", define, measures, ["s"], "t", after="NEXT_ROW")) == [("a", 0, 1), ("a", 1, 2), ("a", 5, 6)]
    assert found(cep.match_recognize(prices, "A B", define, measures, ["s"], "t DESC")) == [("a", 2, 1), ("a", 6, 5)]


def test_optional_alternative_and_counts(prices):
    measures = {"from": "FIRST(X.t)", "sum": "SUM(X.price)", "avg": "AVG(X.price)", "diff": "LAST(X.price) - FIRST(X.price)"}
    out = cep.match_recognize(prices, "X{3}", {"X": "price >= 7"}, measures, ["s"], "t")
    assert found(out) == [("a", 0, 31, 31 / 3, -1.0), ("a", 3, 26, 26 / 3, 4.0)]
    either = cep.match_recognize(prices, "(P|Q) R?", {"P": "price = 10", "Q": "price = 5", "R": "price IN (12, 6)"}, {"p": "P.t", "q": "Q.t", "r": "R.t"}, ["s"], "t")
    assert found(either) == sorted([("a", 0, None, 1), ("a", None, 7, 8), (None, None, 2, None)], key=str)


def test_no_partition_and_empty(prices):
    assert cep.match_recognize(prices, "A", {"A": "price = 1"}, {"s": "A.s"}, order_by="t").collect() == [("b",)]
    assert cep.match_recognize(prices.limit(0), "A", {"A": "price = 1"}, {"s": "A.s"}, ["s"], "t").count() == 0


@pytest.mark.parametrize("bad", ["", "A (B", "A | | B", "A )", "+", "A $"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        cep.parse_pattern(bad) if bad else cep.match_recognize(None, bad, {"A": "true"}, {"x": "A.x"})


def test_rules(prices):
    with pytest.raises(ValueError):
        cep.match_recognize(prices, "A", {"Z": "true"}, {"x": "A.t"})
    with pytest.raises(ValueError):
        cep.match_recognize(prices, "A", {"A": "true"}, {"x": "A.t"}, after="LAST_ROW")


PATTERNS = ["A", "A B", "A* B", "A+ B?", "(A|B)+ C", "A{2,3} B", "A*? B", "(A B)+ C?", "A (B|C)* A", "A{0,2} C", "(A? B?)+ C"]


@settings(max_examples=150, deadline=None)
@given(st.text("ABC", max_size=14), st.sampled_from(PATTERNS))
def test_matching_is_that_of_regular_expressions(text, pattern):
    states, start = cep.compile_pattern(cep.parse_pattern(pattern))
    rows = [{f"__is_{v}": c == v for v in "ABC"} for c in text]
    flags = {v: f"__is_{v}" for v in "ABC"}
    got = ["".join(v for _, v in labels) for labels in cep.match_rows(rows, states, start, flags, {}, "MATCH_RECOGNIZED")]
    want, at = [], 0
    compiled = re.compile(pattern.replace(" ", ""))
    while at < len(text):
        m = compiled.match(text, at)
        if m and m.end() > at:
            want.append(m[0])
            at = m.end()
        else:
            at += 1
    assert got == want


def test_expression_values():
    values = {"a": 3, "b": None, "s": "x"}
    cases = {"a + 1 * 2": 5, "(a + 1) * 2": 8, "-a": -3, "a > 2 AND s = 'x'": True, "b > 1": None, "b > 1 OR a = 3": True, "b > 1 AND a = 4": False, "NOT a = 3": False, "b IS NULL": True, "a IS NOT NULL": True, "a BETWEEN 1 AND 3": True, "a / 0": None, "a % 2": 1}
    assert {k: cep.evaluator(k)(values) for k in cases} == cases
    for bad in ("a +", "(a", "a b", "f(a)"):
        with pytest.raises(ValueError):
            cep.evaluator(bad)


# ---- SQL


def test_views_do_not_leak(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    first = sql.run(spark, "SELECT input.x FROM input", {"input": a})
    second = sql.run(spark, "SELECT x FROM input WHERE 'FROM input' <> ''", {"input": b})
    assert (first.collect(), second.collect()) == ([(1,)], [(2,)])
    both = sql.run(spark, "SELECT a.x, t.x AS y FROM a, b t WHERE EXISTS (SELECT 1 FROM b WHERE b.x > a.x) UNION ALL SELECT x, x FROM b", {"a": a, "b": b})
    assert sorted(map(tuple, both.collect())) == [(1, 2), (2, 2)]


def test_errors_have_names_and_places(spark):
    df = spark.range(1)
    with pytest.raises(SqlError, match="Unknown column 'nope' at line 2, column"):
        sql.run(spark, "SELECT\n  nope FROM input", {"input": df})
    with pytest.raises(SqlError, match="Unknown table 'elsewhere'"):
        sql.run(spark, "SELECT 1 FROM elsewhere", {"input": df})
    with pytest.raises(SqlError):
        sql.run(spark, "SELEC 1", {"input": df})


def test_window_calls():
    assert sql.window_calls("GROUP BY TUMBLE(ts, INTERVAL '5' MINUTE)") == "GROUP BY window(ts, '5 minute')"
    assert sql.window_calls("HOP_END(ts, INTERVAL '1' HOUR, INTERVAL '2' HOUR)") == "window(ts, '2 hour', '1 hour').end"
    assert sql.window_calls("SELECT 'TUMBLE(x)', tumble FROM t") == "SELECT 'TUMBLE(x)', tumble FROM t"


def test_qualify_by_name(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "k int, v int")
    out = sql.run(spark, "SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM input QUALIFY rn = 1", {"input": df})
    assert sorted(map(tuple, out.collect())) == [(1, 9, 1), (2, 3, 1)]


def test_query_clauses(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7), ("c", 9)], "k string, v int")
    out = sql.query(df, {"key": "k", "total": "SUM(v)", "rank": Call("rank", over=WindowSpec((), {"total": "DESC"}))}, where="v < 9", group_by=["k"], having="SUM(v) > 5", order_by={"total": "DESC"})
    assert [tuple(r) for r in out.collect()] == [("b", 7, 1), ("a", 6, 2)]
    frames = sql.query(df, {"v": "v", "run": Call("sum", ("v",), window="w")}, windows={"w": WindowSpec((), {"v": "ASC"}, rows=(None, 0))})
    assert sorted(map(tuple, frames.collect())) == [(1, 1), (5, 6), (7, 13), (9, 22)]
    for bad in (lambda: sql.query(df, {}), lambda: sql.query(df, {"k": "k"}, having="k = 1"), lambda: sql.query(df, {"x": Call("rank", window="none")})):
        with pytest.raises(ValueError):
            bad()
