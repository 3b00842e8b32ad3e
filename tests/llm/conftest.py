import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from eventspark.llm.common import ship

    ship(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew strong tea near old stone walls".split()
    prose = [" ".join(words[(i * k + i) % len(words)] + ("." if k % 7 == 6 else "") for k in range(40 + i)) for i in range(30)]
    rows = [(i, prose[i], "en", f"s{i % 3}", len(prose[i])) for i in range(30)]
    rows += [(0, prose[0], "en", "s0", 1), (31, prose[1], "en", None, 1), (32, None, None, "s1", None), (33, "", "en", "s1", 0),
             (None, prose[2], "en", "s2", 1), (None, None, None, None, None), (34, " \n\t ", "en", "s2", 4),
             (35, "Ünïcode ▁ mark 🤖  two  spaces\n\n end ", "de", "s0", 3), (36, "word " * 60_000, "en", "s0", 300_000)]
    rows = [(*r, "x", 1, "y", "z") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score string, label int, __key string, fp string").repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0), "x") for i in range(25)] + [(None, 1, 1, "x"), (2, None, None, "x"), (3, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
