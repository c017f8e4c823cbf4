"""Every registered query against its SQL restatement."""

import os
import subprocess
import sys

import compare
import pytest

import __spark_entry__ as entry
from gradeline.plans import oracles, registry

QUERIES, ORACLES = registry.QUERIES, oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert compare.differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("gradeline.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from gradeline.plans import oracles, registry
assert set(entry.queries()) == set(registry.QUERIES)
assert entry.oracle_sql() == oracles.oracle_sql()
"""


def test_entry_works_without_the_optional_part():
    repository = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-B", "-c", WITHOUT], cwd=repository, check=True, timeout=120)


def test_entry_ranks_the_runs(spark):
    rows = entry.entry(spark).orderBy("rank").collect()
    assert [(r.rank, r.model, r.strategy, r.n_correct, r.n, r.f1) for r in rows] == [
        (1, "m0", "slm", 191, 200, 0.955),
        (2, "m1", "five_shot", 175, 195, 0.8974),
        (3, "m1", "zero_shot", 161, 200, 0.805),
        (4, "m2", "five_shot_cot", 136, 195, 0.6974),
        (5, "m2", "zero_shot", 121, 200, 0.605),
        (6, "m3", "slm", 102, 200, 0.51),
    ]
