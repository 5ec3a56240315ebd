import pytest

from driftline.plans import changes, recovered, reporting  # noqa: F401  the others add their queries
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(reporting.SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    same(reporting.QUERIES[name](spark, sf_dir), connection, reporting.SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_to_one(spark, sf_dir):
    for name in ("greedy_chunks", "optimal_chunks"):
        rows = reporting.QUERIES[name](spark, sf_dir).collect()
        assert len({(r["block"], r["left"]) for r in rows}) == len(rows) == len({(r["block"], r["right"]) for r in rows})


def test_consensus_is_of_whole_labels(spark, sf_dir):
    labels = [r["label"] for r in reporting.QUERIES["label_consensus"](spark, sf_dir).collect()]
    assert labels and all(x.endswith("in retail store") for x in labels)
