import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA, rows, sql_rows  # noqa: E402

from vellum.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = sql_rows(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
