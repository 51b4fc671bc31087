"""Scratch tables: where they are, and that they go."""

import os

import pytest

import corpus_pipeline
from orogen.llm import entries, shared

SF = "/root/testdata/sf0.001"


def left(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    folder = f"{root}/orogen/{spark.sparkContext.applicationId}"
    return sorted(f for f in os.listdir(folder)) if os.path.isdir(folder) else []


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_nothing_is_left_once_a_result_is_written(spark, name):
    shared.clear_scratch(spark)
    entries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    shared.clear_scratch(spark)
    assert left(spark) == []


def test_pipeline_leaves_its_last_table_only(spark):
    shared.clear_scratch(spark)
    rows = corpus_pipeline.run(spark, SF)
    assert len(left(spark)) == 1 and rows.count() > 0
    shared.clear_scratch(spark)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Cluster:
        conf, master = Conf(), "spark://host:7077"

        @property
        def sparkContext(self):
            return self

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.scratch_path(Cluster(), "x")


def test_batch_size_of_the_session_is_left_alone(spark):
    before = spark.conf.get(shared.BATCH_SETTING, None)
    try:
        spark.conf.set(shared.BATCH_SETTING, str(64 << 20))
        entries.op4_bpe(spark, SF).count()
        assert spark.conf.get(shared.BATCH_SETTING) == str(64 << 20)
    finally:
        spark.conf.unset(shared.BATCH_SETTING) if before is None else spark.conf.set(shared.BATCH_SETTING, before)
