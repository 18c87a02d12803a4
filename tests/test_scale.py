"""Plans that must hold on tables larger than a test's: what is broadcast, and by what rows are shuffled."""

import pytest
from pyspark.sql import functions as F

from thrustlog.operators.analysis import trace_from_readings
from thrustlog.operators.convert import convert, live_feed, wide
from thrustlog.operators.decode import number_batches, readings
from thrustlog.operators.view import latest_points
from thrustlog.plans.scan import number_block
from thrustlog.registry.convert import live_feed as live_feed_query
from thrustlog.registry.streams import feed
from thrustlog.registry.views import CHANNELS, RATE, SENSOR_CONFIG, SENSOR_NAMES
from thrustlog.sources.config import config_rows

CODES = 3000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Batches whose arrays make far more readings than the file's size tells."""
    path = str(tmp_path_factory.mktemp("batches") / "batches")
    rows = spark.range(40).select(
        (F.col("id") % 4).alias("run_id"), F.col("id").alias("batch_id"),
        F.sequence(F.lit(0), F.lit(CODES - 1)).alias("data"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def converted(spark, batches):
    config = config_rows(spark.createDataFrame([(SENSOR_CONFIG,)], "value string"))
    return convert(readings(number_batches(batches, CHANNELS), CHANNELS, RATE), config)


def test_readings_are_neither_broadcast_nor_shuffled_by_channel(spark, batches):
    rows = converted(spark, batches)
    views = [
        rows,
        rows.where(F.col("sensor_name") == "Load Cell"),
        trace_from_readings(rows.drop("run_scans")),
        latest_points(rows, ["run_id", "sensor_name"], ["scan_no"], number_block(F.col("scan_no"), 4096), 40),
    ]
    for view in views:
        plan = plan_of(view)
        assert "BuildLeft" not in plan and "hashpartitioning(channel" not in plan
    assert rows.count() == 40 * CODES


def test_block_table_is_not_broadcast(spark, batches):
    assert "BroadcastExchange" not in plan_of(number_batches(batches, CHANNELS))


def test_wide_moves_scans_not_readings(spark, batches):
    plan = plan_of(wide(converted(spark, batches), SENSOR_NAMES))
    assert plan.count("hashpartitioning(run_id") == plan.count("hashpartitioning(") and "sensor_name" not in "".join(
        line for line in plan.splitlines() if "Exchange hash" in line
    )


def test_wide_values(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0.2, "a", 5.0), (1, 1, 0.2, "b", None), (1, 2, 0.4, "b", 7.0), (None, 1, 0.2, "a", 8.0), (1, 2, 0.4, "other", 9.0)],
        "run_id long, scan_no long, seconds double, sensor_name string, value double",
    )
    got = wide(rows, ["a", "b"])
    assert got.columns == ["run_id", "scan_no", "seconds", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        (1, 1, 0.2, 5.0, None), (1, 2, 0.4, None, 7.0), (None, 1, 0.2, 8.0, None),
    ]


def test_feed_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(tables):
        for table in tables:
            seen.add(table.num_rows)
            yield table

    class Drained:
        def awaitTermination(self):
            pass

    rows = spark.range(100).mapInArrow(counted, "id long")
    feed(rows, "id", str(tmp_path / "in"), lambda stream: Drained())
    assert seen.value == 100
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "in")).collect()) == list(range(100))


def test_live_feed_passes_over_the_readings_once(spark):
    plan = plan_of(live_feed_query(spark, "/root/testdata/sf0.001"))
    assert plan.count("posexplode(") == 1 and "hashpartitioning(run_id" in plan and "hashpartitioning(run_id, sensor_name, raw" not in plan


def test_live_feed_of_both_modes(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0.2, "a", 5.0, 50.0), (1, 2, 0.4, "a", None, 60.0), (None, 1, 0.2, None, 7.0, None), (1, 1, 0.2, "a", 5.0, 50.0)],
        "run_id long, scan_no long, seconds double, sensor_name string, volts double, value double",
    )
    both = live_feed(rows, raw_voltage=None)
    assert both.columns == ["run_id", "scan_no", "seconds", "sensor_name", "raw", "y"]
    for raw in (True, False):
        mode = both.where(F.col("raw") == raw).drop("raw").collect()
        assert sorted(map(str, mode)) == sorted(map(str, live_feed(rows, raw_voltage=raw).collect()))
