import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from rows import same  # noqa: E402

from octoweave.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_ten_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert "pipeline" in entry.queries()
