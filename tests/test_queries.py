"""Each query beside its SQL twin, and those without one for rows and a stable schema."""

import pytest

import __spark_entry__ as entry
from quillmill.plans import registry
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf_dir, con, name):
    assert compare(spark, sf_dir, con, entry.queries()[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_twin(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0 and df.schema == entry.queries()[name](spark, sf_dir).schema


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["a", "b", "strength", "reasons", "feedback"] and got.count() > 0


def test_library_does_not_import_the_corpus_subpackage():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"quillmill\.llm|import llm", p.read_text()), p


def test_flagship_plan(spark, sf_dir):
    plan = entry.queries()["GR18_cross_graph"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
