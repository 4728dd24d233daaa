import __spark_entry__
from spillway import suites


def test_queries_over_parts_of_tables_are_not_registered():
    """Each has a registered one over whole tables."""
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert __spark_entry__.PARTIAL <= set(suites.QUERIES) and not __spark_entry__.PARTIAL & (names | sql)
    assert {f"{k}_whole" for k in __spark_entry__.PARTIAL} <= names & sql
