"""Scalar expressions and stateless operators on small frames with exact results."""

import pytest
from pyspark.sql import types as T

from spillway.functions import Dialect, column, condition, rewrite
from spillway.operators import stateless as s


def values(df, text, dialect=Dialect()):
    return [r["x"] for r in df.select(column(text, dialect, df).alias("x")).collect()]


@pytest.fixture(scope="module")
def rows(spark):
    """Parcels: grams, hub, sender, what was last done, a link to the proof, and the days that customs took."""
    data = [
        (7, "osl", "\tMoë & Sons ", "weighed", "ftp://proofs.osl.no/2024/07.pdf", None),
        (1250, "gva", "LARCH", "sealed", None, 3),
        (-40, None, "quill co", "returned", "see desk 4", 8),
        (310, "osl", "Quill Co", "sealed", "ftp://gva.ch", None),
        (1250, "lim", "", "lost", "http://a.b.pe/x?y=1", 12),
    ]
    return spark.createDataFrame(data, "grams bigint, hub string, sender string, done string, proof string, days bigint")


@pytest.mark.parametrize("text, want", [
    # strings
    ("TRIM(sender)", ["Moë & Sons", "LARCH", "quill co", "Quill Co", ""]),
    ("lower(sender)", ["\tmoë & sons ", "larch", "quill co", "quill co", ""]),
    ("UPPER(TRIM(sender))", ["MOË & SONS", "LARCH", "QUILL CO", "QUILL CO", ""]),
    ("CONCAT(hub, '/', done)", ["osl/weighed", "gva/sealed", None, "osl/sealed", "lim/lost"]),
    ("CONCAT('d', CAST(days AS STRING))", [None, "d3", "d8", None, "d12"]),
    ("SUBSTRING(done, 2, 4)", ["eigh", "eale", "etur", "eale", "ost"]),
    ("SUBSTR(done, 0, 1)", ["w", "s", "r", "s", "l"]),
    ("SUBSTRING(done, -2)", ["weighed", "sealed", "returned", "sealed", "lost"]),
    ("SUBSTRING(done, 7)", ["d", "", "ed", "", ""]),
    ("REGEXP_EXTRACT(proof, '^([a-z]+)://', 1)", ["ftp", None, None, "ftp", "http"]),
    ("REGEXP_EXTRACT(proof, '://([^/]+)/([^?]*)', 2)", ["2024/07.pdf", None, None, None, "x"]),
    ("'SUBSTR(done, 0) 2.5'", ["SUBSTR(done, 0) 2.5"] * 5),
    # numbers
    ("grams % 9", [7, 8, -4, 4, 8]),
    ("-(grams - 10)", [3, -1240, 50, -300, -1240]),
    ("3 * (grams + days)", [None, 3759, -96, None, 3786]),
    ("grams * 0.25", [1.75, 312.5, -10.0, 77.5, 312.5]),
    # conditions
    ("grams = 1250", [False, True, False, False, True]),
    ("hub <> 'osl'", [False, True, None, False, True]),
    ("done != 'sealed'", [True, False, True, False, True]),
    ("grams < 7", [False, False, True, False, False]),
    ("grams <= 7", [True, False, True, False, False]),
    ("days > 3", [None, False, True, None, True]),
    ("days >= 3", [None, True, True, None, True]),
    ("hub IS NULL", [False, False, True, False, False]),
    ("days IS NOT NULL", [False, True, True, False, True]),
    ("NOT grams < 7", [True, True, False, True, True]),
    ("!(done = 'sealed')", [True, False, True, False, True]),
    ("grams > 300 AND done = 'sealed'", [False, True, False, True, False]),
    ("grams > 300 AND days > 3", [False, False, False, None, True]),
    ("days > 3 OR done = 'weighed'", [True, False, True, None, True]),
    # choices
    ("COALESCE(hub, done)", ["osl", "gva", "returned", "osl", "lim"]),
    ("CASE WHEN grams < 0 THEN 'error' WHEN grams < 500 THEN 'letter' ELSE 'crate' END", ["letter", "crate", "error", "letter", "crate"]),
    ("CASE WHEN days > 3 THEN days END", [None, None, 8, None, 12]),
    ("CASE done WHEN 'lost' THEN 9 WHEN 'sealed' THEN 5 ELSE 0 END", [0, 5, 0, 5, 9]),
])
def test_expressions(rows, text, want):
    assert values(rows, text) == want


def test_null_logic(spark):
    df = spark.createDataFrame([(True, None), (False, None)], "a boolean, b boolean")
    assert values(df, "a OR b") == [True, None] and values(df, "a AND b") == [None, False]


def test_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t  a b\n",), (None,)], "s string")
    assert values(df, "TRIM(s)") == ["a b", None]
    assert values(df, "TRIM(s)", Dialect(compat=False))[0] != "a b"
    assert values(df, "TRIM(BOTH ' ' FROM '  x ')") == ["x", "x"]


def test_integer_division(rows):
    exact = Dialect(integer_division=True)
    assert values(rows, "grams / 9", exact) == [0, 138, -4, 34, 138]
    assert values(rows, "(grams - 2) / days", exact) == [None, 416, -5, None, 104]
    assert values(rows, "grams / 4.0", exact) == values(rows, "grams / 4") == [1.75, 312.5, -10.0, 77.5, 312.5]


def test_rewrite_leaves_other_text_alone():
    for text in ("a = 'REGEXP_EXTRACT(b, c)'", "`TRIM`", "trim", "x.substring", "/* TRIM(a) */ b"):
        assert rewrite(text) == text
    with pytest.raises(ValueError):
        rewrite("TRIM(a")


def test_unknown_function_and_type(rows):
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        values(rows, "WEIGH(grams)")
    with pytest.raises(TypeError):
        condition(rows, "grams * 2")


def test_filter(rows, spark):
    assert [r["done"] for r in s.where(rows, "grams > 300").collect()] == ["sealed", "sealed", "lost"]
    assert s.where(rows, "grams > 5000").isEmpty()
    assert [r["hub"] for r in s.where(rows, "days < 5").collect()] == ["gva"]  # a null condition keeps nothing
    for n in (0, 3, 10_001):
        assert s.where(spark.range(n), "id >= 0").count() == n


def test_map_sorts_columns(rows):
    out = s.project(rows.limit(1), {"short": "SUBSTRING(done, 1, 2)", "kilos": "grams / 1000", "grams": "grams + 3"})
    assert out.columns == ["grams", "kilos", "short"] and out.collect() == [(10, 0.007, "we")]
    assert s.project(rows, {"z": "hub", "y": "done"}, preserve_order=True).columns == ["z", "y"]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert s.rename(df, {"a": "b", "b": "a", "x": "y"}).columns == ["b", "a", "c"]
    assert s.rename(df, {"a": "b", "b": "a"}).collect()[0].asDict() == {"b": 1, "a": 2, "c": 3}
    assert s.drop(df, ["b", "x"]).columns == ["a", "c"]
    assert s.pick(df, ["c", "a"]).collect() == [(3, 1)]
    with pytest.raises(KeyError):
        s.pick(df, ["z"])
    assert s.add(df, {"d": "a + b"}, {"d": T.DoubleType()}).collect() == [(1, 2, 3, 3.0)]
    with pytest.raises(ValueError):
        s.add(df, {"a": "1"})


def test_cast_and_fill(spark):
    df = spark.createDataFrame([(4, "7", 2.9, None), (-1, "x", -2.9, "k")], "i bigint, s string, f double, n string")
    out = s.cast(df, {"i": T.DoubleType(), "f": T.LongType(), "s": T.LongType()}, on_error="null").collect()
    assert [tuple(r) for r in out] == [(4.0, 7, 2, None), (-1.0, None, -2, "k")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        s.cast(df, {"s": T.LongType()}).collect()
    with pytest.raises(KeyError):
        s.cast(df, {"zzz": T.LongType()})
    assert [r["b"] for r in s.cast(df, {"i": T.BooleanType()}).selectExpr("i AS b").collect()] == [True, True]
    assert [r["n"] for r in s.fill(df, {"n": "concat('d', s)"}).collect()] == ["d7", "k"]


def test_unnest(spark):
    df = spark.createDataFrame([(5, None, "x"), (6, ["q", None], "y"), (7, [], "z"), (8, ["q"], None)], "id int, tags array<string>, rest string")
    out = s.unnest(df, "tags")
    assert out.columns == ["id", "tags", "rest"] and [tuple(r) for r in out.collect()] == [(6, "q", "y"), (6, None, "y"), (8, "q", None)]
    assert s.unnest(df, "tags", {"tag": T.StringType()}).columns == ["id", "tag", "rest"]
    pairs = spark.createDataFrame([(1, [(5, "q")])], "id int, xs array<struct<k:int,v:string>>")
    assert s.unnest(pairs, "xs", {"k": T.LongType(), "v": T.StringType()}).collect() == [(1, 5, "q")]
    with pytest.raises(TypeError):
        s.unnest(df, "id")


def test_union_and_route(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("x", 1)], "t string, i int")
    assert s.union([a, b]).collect() == [(1, "x"), (1, "x")]
    with pytest.raises(TypeError):
        s.union([a, b.withColumnRenamed("i", "j")])
    df = spark.createDataFrame([("red", 4), ("blue", None), ("red", 9), (None, 2), ("green", 9)], "hue string, size int")
    red, big, rest = s.route(df, ["hue = 'red'", "size > 5"])
    assert [[tuple(r) for r in x.collect()] for x in (red, big, rest)] == [[("red", 4), ("red", 9)], [("green", 9)], [("blue", None), (None, 2)]]
    with pytest.raises(ValueError):
        s.route(df, [])
