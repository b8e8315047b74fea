import duckdb
import pytest

from loomgrid import queries as q

TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


def plain(frame, cols):
    def one(v):
        if v is None or v != v:
            return ""
        return f"{float(v) + 0:.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf_dir, name):
    got = q.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in q.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(q.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols and plain(got, cols) == plain(want, cols)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
