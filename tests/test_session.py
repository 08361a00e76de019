import pytest
from pyspark.sql import functions as F

from lagcast import session


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert named in session.shared_dir(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_cluster_needs_a_named_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_settled_cuts_lineage(spark):
    df = session.settled(spark.range(10).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    assert "rand" not in df._jdf.queryExecution().toString()


def test_held_is_released(spark):
    df = spark.range(10)
    with session.held(df) as kept:
        assert kept.storageLevel.useMemory
    assert not df.storageLevel.useMemory
