"""Every registered query beside its check SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import canonical, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@needs_data
def test_entry(spark):
    assert entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert mine[1]
    if name in SQL:
        cur = con.execute(SQL[name])
        types = {d[0]: KINDS[str(d[1])] for d in cur.description}
        assert types == dict(df.dtypes)
        assert mine == canonical([d[0] for d in cur.description], cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["kin_verbose", "match_counts", "pack_stream", "split_on_event_start", "w1_batched",
                                  "coverage_mmd", "bucket_quantile", "smooth_ema", "src_event_text"])
def test_range_partitioned_order_gives_the_same(spark, con, monkeypatch, name):
    """Ranges that adaptive execution would fold into one on small tables."""
    from eventspark.operators import ordering

    monkeypatch.setattr(ordering, "PARTITIONS", 6)
    test_query(spark, con, name)
