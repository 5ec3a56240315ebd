"""Every registered query of the reporting library runs on the small tables and has rows."""

import pytest

from driftline.plans import changes, recovered, reporting  # noqa: F401  the others add their queries

WITHOUT_SQL = sorted(set(reporting.QUERIES) - set(reporting.SQL))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs_and_has_rows(spark, sf_dir, name):
    """Those with SQL run in test_queries."""
    assert reporting.QUERIES[name](spark, sf_dir).count() > 0


def test_compared_queries_are_not_empty(spark, sf_dir):
    for name in ("aligned_chunks", "clear_margins", "fragment_coverage", "pair_evidence"):
        assert reporting.QUERIES[name](spark, sf_dir).count() > 0, name
