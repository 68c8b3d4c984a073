import pytest
from compare import same

import __spark_entry__ as entry
from genolith.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_cohort_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
