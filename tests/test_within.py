import pytest

from palaver.functions.text import normalized
from palaver.operators.within import depth, within


@pytest.fixture(scope="module")
def segments(spark):
    rows = [(1, 1, 0, "dialogue", "a red fox"), (1, 2, 0, "thinking", "Red fox red fox"), (1, 2, 1, "tool", "the Red fox"), (1, 3, 0, "dialogue", "nothing"), (2, 1, 0, "dialogue", "red")]
    return spark.createDataFrame(rows, "key int, ordinal int, part int, source string, text string").withColumn("norm", normalized("text"))


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(1, 3, 0.9), (1, 1, 0.2), (1, 1, 0.4), (3, 1, 0.1)], "key int, ordinal int, score double")


def rows(found):
    return sorted((r.key, r.place, r.ordinal, r.kind) for r in found.collect())


def test_modes(segments, passages):
    assert rows(within(segments, "red fox", 5)) == [(1, 1, 1, "lexical"), (1, 2, 2, "lexical")]
    assert rows(within(segments, '"Red"', 5, passages, asked="semantic")) == [(1, 1, 2, "lexical")]  # quoted text alone is exact
    assert rows(within(segments, "red", 1, passages, switch=True)) == [(1, 1, 3, "semantic"), (3, 1, 1, "semantic")]
    assert rows(within(segments, "red fox", 9, passages, asked="hybrid")) == [(1, 1, 1, "hybrid"), (1, 2, 2, "lexical"), (1, 3, 3, "semantic"), (3, 1, 1, "semantic")]
    with pytest.raises(ValueError):
        within(segments, "red", 3, asked="hybrid")
    assert (depth(1), depth(20), depth(500)) == (50, 160, 1000)


def test_only_the_first_hits_travel(segments):
    plan = within(segments, "red", 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
