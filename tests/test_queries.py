"""Every registered query against its SQL on whole tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import compare
import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.difference(df, duck, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "n", "occurrences", "distinct_entities", "words", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("missing", ["tokenizers", "public_tokenizers", "xxhash", "lethe.llm"])
def test_other_queries_load_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True).stdout
    kept = [q for q in NAMES if q != "pipeline" and not (q.startswith("op") and q[2].isdigit())]
    assert out.split() == [str(len(kept)), "False"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
