"""Who owns a table, and when it goes."""

import os

import pytest

from engramark.llm import scratch


def test_release_leaves_the_tables_of_others(spark):
    with scratch.owner("one"):
        one = scratch.written(spark.range(3).toDF("x"), "t")
    with scratch.owner("two"):
        two = scratch.written(spark.range(4).toDF("x"), "t")
    scratch.release(spark, "one")
    assert two.count() == 4
    with pytest.raises(Exception):
        one.count()
    scratch.release(spark, "one")


def test_settled_removes_what_steps_wrote(spark):
    seen = []

    def steps():
        table = scratch.written(spark.range(5).toDF("x"), "step")
        seen.append(table.inputFiles()[0].removeprefix("file://"))
        return table.where("x > 1")

    assert scratch.settled(spark, "result", steps).count() == 3
    assert not os.path.exists(seen[0])
