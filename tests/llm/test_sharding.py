"""Extendible hashing: byte limits, one shard for a row, repeated ids, no Python in the plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventspark.llm import extendible_sharding as es


@pytest.mark.parametrize("limit", [200, 2000, 1 << 30])
@pytest.mark.parametrize("pass_bits", [3, es.PASS_BITS])
def test_limits(spark, odd_docs, limit, pass_bits):
    rows = es.store(es.keyed(odd_docs.select("doc_id", "text")).drop("text"), "bits")
    shards = es.store(es.directory(rows, limit, pass_bits), "directory")
    table = shards.collect()
    prefixes = [r["prefix"] for r in table]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    placed = es.assign(rows, shards).collect()
    assert len(placed) == odd_docs.count()
    size, count = Counter(), Counter()
    for r in placed:
        assert r["__bits"].startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        size[r["shard"]] += r["__bytes"]
        count[r["shard"]] += 1
    for r in table:
        assert (size[r["prefix"]], count[r["prefix"]]) == (r["shard_bytes"], r["shard_rows"])
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
    # no shard could have been left whole: the entry above it is too large
    for p in prefixes:
        if p:
            above = [r for r in placed if r["__bits"].startswith(p[:-1])]
            assert sum(r["__bytes"] for r in above) > limit and len(above) > 1


def test_one_repeated_id_is_divided(spark):
    docs = spark.createDataFrame([(7, "same text")] * 500 + [(8, "other")], "doc_id long, text string").repartition(4)
    table = es.shard_table(docs, 100).collect()
    assert len(table) == 501 and max(r["shard_bytes"] for r in table) <= 100


def test_empty_and_written(spark, odd_docs, tmp_path):
    assert es.shard_table(odd_docs.limit(0)).count() == 0
    odd_docs = odd_docs.withColumn("shard", F.lit("own")).withColumn("depth", F.lit(3))
    path = str(tmp_path / "shards")
    shards = es.write_shards(odd_docs, path, 2000)
    back = spark.read.parquet(path)
    assert back.count() == odd_docs.count() and set(odd_docs.columns) <= set(back.columns)
    assert back.select("shard_").distinct().count() == shards.count()


def test_plan_is_native(spark, odd_docs):
    plan = es.shard_table(odd_docs, 2000)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
