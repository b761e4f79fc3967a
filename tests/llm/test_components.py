import pytest

from palaver.llm.common import Scratch
from palaver.llm.components import connected_components


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(path, Scratch(spark, "t"), most_rounds=2)
    assert {r.component for r in connected_components(path, Scratch(spark, "t")).collect()} == {0}
