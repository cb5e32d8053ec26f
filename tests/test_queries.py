"""Every registered query runs at sf0.001; those with a SQL twin match
DuckDB (rows, columns and values)."""

from conftest import SF_SMALL


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "itemset" in df.columns


def test_queries_match_oracles(spark):
    import __spark_entry__ as E
    import tools.check_oracles as C
    assert set(E.oracle_sql()) <= set(E.queries())
    C.EXACT = True                     # floats must match bit for bit
    try:
        res = C.check(spark, SF_SMALL, verbose=True)
    finally:
        C.EXACT = False
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    assert not bad, bad
