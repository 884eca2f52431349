import os

import duckdb
import pytest

from sluice.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_and_sql_agree(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)

    def order(rows):
        return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])

    want = order([tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in cur.fetchall()])
    have = order([tuple(bytes(r[n]) if isinstance(r[n], bytearray) else r[n] for n in names) for r in df.collect()])
    assert have == want


def test_the_rest_stands_without_the_llm_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['sluice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'infer_types' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
