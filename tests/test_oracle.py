"""Every registered query against its DuckDB text, on the smallest scale factor."""

import pytest

import __spark_entry__ as contract
from tests.harness import compare

JOBS, ORACLES = contract.queries(), contract.oracle_sql()
# empty on the smallest tables, checked on larger ones
MAY_BE_EMPTY = {"tfbs_chain", "contains_match", "first_match_unique", "coexpression_significant", "enriched_terms", "expression_slice"}


def test_flagship_is_registered_and_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["chr", "locus", "snp", "gene_id", "score"]
    assert df.count() == 22


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(name, spark, con, sf_dir):
    df = JOBS[name](spark, sf_dir)
    if name in ORACLES:
        why, n = compare(df, con, ORACLES[name])
        assert not why
    else:
        n = df.count()
    assert n or name in MAY_BE_EMPTY
