import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventspark.operators.ordering import ranges, running, with_position
from eventspark.operators.sequences import epoch_shuffle, rank_slices
from eventspark.scratch import clear, scratch_root


def table(spark, n=5000, partitions=7):
    """Group 0 holds more than a third of the rows."""
    return spark.range(0, n, 1, partitions).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 13).alias("g"),
        ((F.col("id") * 7919) % n).alias("o"), (F.col("id") % 17).alias("v"))


def spans_partitions(df, groups, partitions):
    """The range partitioning that the code under test makes has several partitions with rows."""
    return ranges(df, ["o"], groups, {}, partitions).select("__part").distinct().count() >= min(partitions, 4)


@pytest.mark.parametrize("bounded,partitions", [(True, None), (False, 1), (False, 8)])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_both_ways_equal_pandas(spark, bounded, partitions, groups):
    if bounded and not groups:
        pytest.skip("the whole table is no bounded group")
    df = table(spark)
    assert partitions is None or spans_partitions(df, groups, partitions)
    out = running(df, ["o"], groups, position="p", sums={"s": F.col("v")}, following={"nxt": "o"}, bounded=bounded, partitions=partitions)
    got = out.toPandas().sort_values(["g", "o"]).reset_index(drop=True)
    exp = df.toPandas().sort_values([*groups, "o"]).reset_index(drop=True)
    by = exp.groupby(groups, sort=False) if groups else exp
    exp["p"] = by.cumcount() if groups else np.arange(len(exp))
    exp["s"] = by["v"].cumsum()
    exp["nxt"] = by["o"].shift(-1)
    exp = exp.sort_values(["g", "o"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[exp.columns.tolist()], exp, check_dtype=False)


def test_range_way_is_independent_of_partitioning(spark):
    df = table(spark, 2000)
    a = with_position(df.repartition(3), ["o"], ["g"], partitions=5).orderBy("g", "o").collect()
    b = with_position(df.repartition(11), ["o"], ["g"], bounded=True).orderBy("g", "o").collect()
    assert a == b


def test_null_groups_and_null_followers_equal_a_window(spark):
    """60 rows over 8 range partitions; the null group and null values lie across their borders."""
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), "id",
                                F.when(F.col("id") % 4 > 0, F.col("id")).alias("v"))
    assert ranges(df, ["id"], ["g"], {}, 8).select("__part").distinct().count() == 8
    ways = [running(df, ["id"], ["g"], "p", {"s": F.col("v")}, {"nxt": "v"}, **how).orderBy("id").collect()
            for how in ({"bounded": True}, {"partitions": 8})]
    assert ways[0] == ways[1]


def test_rank_slices(spark):
    got = rank_slices(spark.range(10), "id", 3).groupBy("shard").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2), (1, 3, 5), (2, 6, 9)]


def test_shuffle_is_a_permutation_that_depends_on_the_epoch(spark):
    ids = spark.range(200)
    first = [r.id for r in epoch_shuffle(ids, "id", 7, 0).orderBy("place").collect()]
    again = [r.id for r in epoch_shuffle(ids.repartition(5), "id", 7, 0).orderBy("place").collect()]
    other = [r.id for r in epoch_shuffle(ids, "id", 7, 1).orderBy("place").collect()]
    assert first == again and sorted(first) == list(range(200)) and first != other


def test_written_tables_can_be_cleared(spark):
    import os

    with_position(table(spark, 50), ["o"]).collect()
    here = lambda: [f for f in os.listdir(scratch_root(spark)) if f.startswith("eventspark-")]
    assert here()
    clear(spark)
    assert not here()


def test_files_of_the_sources_are_cleared_too(spark):
    import os

    from eventspark.plans import files, runs

    clear(spark)
    here = lambda: [f for f in os.listdir(scratch_root(spark)) if f.startswith("eventspark-")]
    before = set(here())
    for query in (files.src_token_bin, files.src_event_bin, runs.src_train_log):
        assert query(spark, "/root/testdata/sf0.001").count()
    assert set(here()) > before
    clear(spark)
    assert set(here()) == before


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
