"""Every query that has SQL against DuckDB, and that the rest of the library needs nothing of the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from tessella.plans import registry
from tests.conftest import DATA

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark):
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert rows and all(len(r) == len(rows[0]) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_llm_subpackage():
    code = "import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'change_set_topk' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
