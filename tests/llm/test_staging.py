"""Tables that are staged within a scope go at its end; the pipeline leaves its result alone."""

import os

import numpy as np

import corpus_pipeline
from roiscore.llm import common
from roiscore.llm.repeats import _earliest



def folders(spark):
    return {x for x in os.listdir(common.shared_dir(spark).removeprefix("file:")) if x.startswith(("staged-", "pipeline-"))}


def test_scopes_remove_their_own_tables(spark):
    before = folders(spark)
    with common.scope(spark):
        outer = common.staged(spark.range(5))
        with common.scope(spark):
            assert common.staged(spark.range(7)).count() == 7
        assert len(folders(spark) - before) == 1 and outer.count() == 5
    assert folders(spark) == before
    common.staged(spark.range(3))
    assert len(folders(spark) - before) == 1


def test_the_pipeline_leaves_its_result_alone(spark):
    before = folders(spark)
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = folders(spark) - before
    assert len(left) == 1 and result.count() > 0
    path = common.shared_dir(spark).removeprefix("file:") + "/" + left.pop()
    assert os.listdir(path) == ["packing"]


def test_windows_of_one_hash_are_told_apart_by_their_smallest_run():
    value, key, start = np.array([5, 5, 5], np.uint64), np.arange(3), np.zeros(3, np.int64)
    order, first, late = _earliest(value, np.array([1, 2, 1], np.uint64), key, key, start)
    assert order.tolist() == [0, 2, 1] and first.tolist() == [True, False, True] and late.tolist() == [False, True, False]
