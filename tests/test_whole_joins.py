import duckdb
import pytest

from spillway import suites  # noqa: F401
from spillway.suites.base import ORACLE, QUERIES


@pytest.mark.parametrize("name", [*(f"join_{k}_whole" for k in ("inner", "left", "right", "full", "semi", "anti")), "union_all_whole"])
def test_whole_tables(spark, sf_dir, name):
    """All rows of both tables reach the query: nothing but a join's null keys may be filtered."""
    db = duckdb.connect()
    for t in ("customer", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    assert df.count() == len(db.execute(ORACLE[name]).fetchall()) > 0
    assert "%" not in ORACLE[name] and "<" not in ORACLE[name]


@pytest.mark.parametrize("kind,rows", [("inner", 1), ("left", 2), ("right", 3), ("full", 4), ("semi", 1), ("anti", 1)])
def test_unmatched_rows_on_both_sides(spark, tmp_path, kind, rows):
    spark.createDataFrame([(1, "a"), (2, "b")], "c_custkey bigint, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(10, 1), (11, 3), (12, None)], "event_id bigint, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES[f"join_{kind}_whole"](spark, str(tmp_path)).count() == rows
