import pytest
from compare import DATA, rows, sql_rows

from vellum.plans import catalogue, checks  # noqa: F401, checks registers its queries


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = sql_rows(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_need_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['vellum.llm'] = None; import __spark_entry__ as e; assert e.corpus is None and e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120, check=False).returncode == 0
