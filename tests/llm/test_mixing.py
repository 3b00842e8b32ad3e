"""Targets, epochs and the fractional selection."""

import math
import re

import pytest

from eventspark.llm import source_mixing as sm


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] >= most * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("ordered_rows", [sm.ORDERED_ROWS, 1])
def test_plan(spark, odd_docs, ordered_rows):
    docs = odd_docs.collect()
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + size_of(d["text"])
    want = brute_targets(sizes)
    plan = sm.plan(odd_docs, ordered_rows=ordered_rows)
    rows = plan.collect()
    assert len(rows) == len(docs)
    assert sorted(r["size"] for r in rows) == sorted(size_of(d["text"]) for d in docs)
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted(taken) == sorted((n, pytest.approx(want[s])) for s, n in sizes.items())
    for (_, target), words in taken.items():
        assert abs(sum(words) - target) <= 0.5
    again = sm.plan(odd_docs.repartition(7), ordered_rows=ordered_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_fractions_go_to_the_smallest_keys(spark):
    docs = spark.createDataFrame([(i, "word " * 5, "a") for i in range(200)] + [(1000, "w " * 9000, "b")],
                                 "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in sm.plan(docs, weights=(1.0, 1.0), share=0.05).filter("doc_id < 1000").collect()}
    keys = {r[0]: r[1] for r in sm.keyed(docs).select("doc_id", "__mix_key").collect()}
    some = sorted(taken, key=keys.get)
    whole = [taken[i] for i in some]
    assert whole == sorted(whole, reverse=True) and 0 < sum(whole) < 1000
    assert all(math.isfinite(k) for k in keys.values())


def test_mixed_rows(spark, odd_docs):
    want = {}
    for r in sm.plan(odd_docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    mixed = sm.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + size_of(r["text"])
    assert got == {k: v for k, v in want.items() if v}
    assert {r["__key"] for r in mixed.collect()} == {"y"}  # a column of the input keeps its values


def test_empty_table(spark, odd_docs):
    assert sm.plan(odd_docs.limit(0)).count() == 0 and sm.mix(odd_docs.limit(0)).count() == 0
    nothing = odd_docs.filter("text is null or text = ''")
    assert [r["taken"] for r in sm.plan(nothing).collect()] == [0] * nothing.count()


def test_a_repeated_id_is_no_single_range(spark):
    """One id in a third of the rows, where the budget ends: its texts still lie in many ranges."""
    rows = [(7, f"word {'x ' * (k % 90)}", "a") for k in range(900)] + [(k + 10, "other words here", "a") for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = sm.keyed(docs).filter("doc_id = 7").groupBy("__mix_at").count().collect()
    assert len(places) > 80 and max(r["count"] for r in places) <= 20
    plan = sm.plan(docs, weights=(1.0,), share=0.5, ordered_rows=5).collect()
    assert abs(sum(r["taken"] for r in plan) - plan[0]["target"]) <= 0.5


def test_columns_with_names_of_the_operator_pass(spark):
    docs = spark.createDataFrame([(i, "some words", "a", i, i + 0.5) for i in range(20)], "doc_id long, text string, source string, __mix_size long, __mix_row double")
    got = sm.mix(docs).select("doc_id", "__mix_size", "__mix_row").distinct().collect()
    assert all((r[1], r[2]) == (r[0], r[0] + 0.5) for r in got) and got
