"""A few registered queries against their SQL on the smallest tables, and contract checks."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
PICK = ["bed_clustering", "merge_intervals", "gene_effects", "allele_frequencies", "classify_inversions", "discordant_pair_test", "standardize_manta", "read_vcf_genotypes"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    import duckdb
    from tools.check import RAW, norm

    con = duckdb.connect()
    for r in RAW:
        con.execute(f"create view {r} as select * from '{SF}/{r}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
