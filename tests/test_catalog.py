"""Every registered query against its SQL twin on the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canonical, oracle_connection, same  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def twin():
    return oracle_connection(FOLDER)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "slot_key" in df.columns


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_twin(spark, twin, name):
    df = entry.queries()[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    relation = twin.execute(entry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    want = canonical(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for mine, theirs in zip(got, want):
        assert all(same(a, b) for a, b in zip(mine, theirs)), (mine, theirs)
