from pyspark.sql import functions as F

from alertweave import session
from alertweave.settings import Settings

import pytest


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Session:
    def __init__(self, value, master="local[2]"):
        self.conf = _Conf(value)
        self.sparkContext = type("Context", (), {"master": master})


def test_the_folder_of_the_session_is_used():
    assert session.shared_folder(_Session("hdfs://x/ckpt/")) == "hdfs://x/ckpt"
    assert session.fresh_path(_Session("/s"), "a").startswith("/s/alertweave/a-")
    assert session.fresh_path(_Session("/s"), "a") != session.fresh_path(_Session("/s"), "a")


def test_without_one_a_local_folder_is_made_once():
    assert session.shared_folder(_Session(None)) == session.shared_folder(_Session(""))


def test_a_cluster_without_one_is_an_error():
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(_Session(None, master))


def test_materialised_table_equals_its_source(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS a", "parse_json('{\"k\":1}') AS v")
    back = session.materialise(df, "check")
    assert sorted(r["id"] for r in back.collect()) == [0, 1, 2, 3, 4] and back.columns == df.columns


@pytest.mark.parametrize("name", ["lookback_minutes", "history_max_results", "cache_ttl_seconds", "delivery_batch_size"])
def test_limits_must_be_positive(name):
    with pytest.raises(ValueError):
        Settings(**{name: 0})


def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(4000).selectExpr("id", "IF(id % 3 = 0, NULL, 7) AS same").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows = session.dealt(table)
    parts = rows.groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(parts) == 2 * cores and max(p["count"] for p in parts) < 2 * 4000 / (2 * cores)
    assert sorted(r["id"] for r in rows.collect()) == list(range(4000))


def test_large_tables_are_not_broadcast_by_their_estimate(spark):
    wide = "array(parse_json('{\"k\":1}')) AS v"
    many = session.materialise(spark.range(700_000).selectExpr("id", "id % 7 AS n", wide), "many").select("id", "n")
    few = session.materialise(spark.range(40).selectExpr("id", "id % 3 AS m", wide), "few").select("id", "m")
    # By the estimate from the widths of its columns ``many`` would be sent to every task.
    assert 16 << 10 < many._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 << 20
    for other, broadcast in ((many.withColumnRenamed("n", "m"), False), (few, True)):
        joined = many.join(other, "id").groupBy("m").count()
        assert sum(r["count"] for r in joined.collect()) == other.count()
        # The plan that ran, and the one before any size was known.
        assert ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) is broadcast
