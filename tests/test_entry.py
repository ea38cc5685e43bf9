import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
STREAMS = {"stream_interest", "stream_medians", "stream_sessions"}


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def _plain(rows, columns):
    def cell(x):
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return float(x) if type(x).__name__ == "Decimal" else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(cell(r[i]) for i in order)) for r in rows))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - STREAMS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, D)
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    got = df.toPandas()
    fix = lambda p: [tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in p.itertuples(index=False)]
    assert _plain(fix(got), list(got.columns)) == _plain(fix(want), list(want.columns))


def test_core_stands_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['receiptlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True).returncode == 0
