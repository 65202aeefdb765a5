"""Every engine query against its SQL; those without SQL must run."""

import pytest

from palaver.plans.queries import QUERIES, SQL
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        same(spark, FOLDER, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_double_ingest_changes_nothing(spark):
    from palaver.sources import fixtures, messages

    log = fixtures.event_log(spark, FOLDER).select("event_id", "session_id")
    once = messages.ingest(log.limit(0), log).drop("inserted")
    twice = messages.ingest(once, log)
    assert twice.filter("inserted").count() == 0 and twice.count() == once.count()
