import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from rulewright.plans import corpus_queries as tables_of
from rulewright.plans import queries as rules

DATA = os.environ.get("RULEWRIGHT_TESTDATA", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cell(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(round(value, 9) if isinstance(value, float) else value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    frame = entry.queries()[name](spark, DATA)
    answer = tables.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    got = sorted(tuple(cell(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    at = [answer.columns.index(c) for c in sorted(answer.columns)]
    assert got == sorted(tuple(cell(r[k]) for k in at) for r in answer.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_stands_without_the_optional_operators(tmp_path):
    """As if the folder and the pipeline had been deleted."""
    hide = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['rulewright.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(rules.QUERIES) + len(tables_of.QUERIES)), str(len(rules.ORACLE_SQL) + len(tables_of.ORACLE_SQL))]


def test_a_missing_dependency_of_theirs_is_no_silence():
    hide = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True, check=False)
    assert not os.path.isdir(f"{ROOT}/rulewright/llm") or (out.returncode and "xxhash" in out.stderr)


def test_nothing_else_imports_the_optional_operators():
    for path in glob.glob(f"{ROOT}/rulewright/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as f:
                assert "llm" not in f.read(), path
