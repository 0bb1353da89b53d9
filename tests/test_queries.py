"""Every query against its SQL on the same tables."""

import pytest
from support import SMALL, same

from tideloom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert same(QUERIES[name](spark, SMALL), duck.execute(ORACLE_SQL[name])) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_execution_has_its_result_map(spark):
    jobs = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["task_results_all"](spark, SMALL).count() == jobs


def test_streamed_states_are_those_of_the_fold(spark):
    states = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, SMALL).select("job_id", "status", "applied").collect())
    assert states("stream_report_states") == states("job_state_machine")
