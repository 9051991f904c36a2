"""Every query against its SQL on the small tables; the rest must run."""

import pytest

import __spark_entry__ as entry
from kinweave.plans import linkage_queries as lq
from tests.conftest import SF, rows

SLOW = {"gbt_two_stage", "self_training", "pair_features", "stage2_similarities"}


@pytest.mark.parametrize("name", [n for n in lq.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = lq.QUERIES[name](spark, SF).toPandas()
    if name in lq.SQL:
        want = duck.execute(lq.SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()))"], cwd=top, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr
