import glob
import os

import duckdb
import pytest

from evalframe.llm.oracle import oracle_sql
from evalframe.llm.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
COLUMNS = {
    "p1_found": ["spec_id_a", "spec_id_b"], "p2_found": ["dimension", "category"], "p3_found": ["solution_id"], "p4_found": ["tbl", "kept_id", "copy_id"], "p5_found": ["pair_id", "field", "defect"],
    "p6_found": ["case_id_a", "case_id_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    sql = oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(repr([r[c] for c in cols]) for r in rows) == sorted(repr(list(r)) for r in cur.fetchall())
