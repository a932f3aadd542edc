import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ("r05_existence", "t04_combine_parts", "c1_build_coverage", "k1_cohort_reason", "d1_compare_versions", "z1_field_missingness", "w1_watch_stream", "h1_multiset_fingerprint", "q2_allocate")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(str([dict(zip(cols, r, strict=True))[c] for c in order]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == want
