import pytest
from pyspark.sql import functions as F

from palaver.sources import rollouts

HEADS = [
    ("{}", "interactive", None),
    ('{"source":null}', "interactive", None),
    ('{"source":"vscode"}', "interactive", None),
    ('{"source":"mcp"}', "automated", None),
    ('{"source":"other"}', "unknown", None),
    ('{"source":{"subagent":null}}', "unknown", ""),
    ('{"source":{"subagent":"review"},"parent_thread_id":"p"}', "unknown", "p"),
    ('{"source":{"subagent":{"thread_spawn":{"parent_thread_id":"s"}}},"parent_thread_id":"p"}', "unknown", "s"),
    ('{"source":"exec","parent_thread_id":"p"}', "automated", "p"),
]


@pytest.mark.parametrize("meta, mode, parent", HEADS)
def test_heads(spark, meta, mode, parent):
    m = F.col("m")
    assert tuple(spark.createDataFrame([(meta,)], "m string").select(rollouts.mode(m), rollouts.parent(m)).first()) == (mode, parent)


def test_last_activity(spark):
    rows = [("a", 1, False), ("a", 9, True), ("b", 4, True), ("b", None, False), ("c", None, False)]
    got = rollouts.last_activity(spark.createDataFrame(rows, "key string, ts int, inherited boolean"))
    assert {r.key: r.last for r in got.collect()} == {"a": 1, "b": 4, "c": None}
