"""Every registered query beside its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference, spark_result, sql_result
from tidemark.workload.registry import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    query = QUERIES[name]
    got = spark_result(query.build(spark, sf_dir))
    if query.sql is None:
        assert got[0]
    else:
        assert difference(got, sql_result(duck, query.sql)) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_contract_without_training_data_operators():
    """The other queries are there when that subpackage is not."""
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(contract.__file__).parent, capture_output=True, text=True, check=True)
    assert done.stdout.split() == sorted(QUERIES)
