from fleetline.plans import catalog
from fleetline.session import SCALE_CONF, cluster_conf
from tests.conftest import SF_SMALL


def test_a_plan_reads_files_added_between_two_calls(spark, tmp_path):
    folder = str(tmp_path)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    first, rest = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    first.write.parquet(f"{folder}/events.parquet")
    plan = catalog.PLANS["v9_heartbeat_outcomes"]
    assert plan(spark, folder).count() == first.count()
    rest.write.mode("append").parquet(f"{folder}/events.parquet")
    assert plan(spark, folder).count() == events.count()


def test_a_scan_is_not_repartitioned(spark):
    plan = catalog.PLANS["v9_heartbeat_outcomes"](spark, SF_SMALL)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 << 40, target_partition_bytes=256 << 20, executors_cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert all(c[k] == v for k, v in SCALE_CONF.items())
    small = cluster_conf(1 << 30, executors_cores=8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 8000   # at least one per core
