"""Wide scans of stands with different sensors."""

import pytest
from pyspark.sql import functions as F

from thrustlog.operators.convert import wide_scans
from thrustlog.operators.decode import number_batches
from thrustlog.operators.fleet import fleet_wide_scans, stand_sensors, with_channels
from thrustlog.registry.views import SENSOR_NAMES, sensors
from thrustlog.schemas import RAW_BATCH

RATE = 10


def batches(spark):
    rows = [(run, b, 2, 1, [2048 + 7 * b + i for i in range(13)]) for run in ("a", "b") for b in (1, 2)]
    return spark.createDataFrame([*rows, ("a", 3, 2, 1, None), ("b", 3, 2, 1, [1, 2])], RAW_BATCH)


def config(spark):
    """Stand a has all five sensors; b has two, the pressure first."""
    a = sensors(spark).withColumn("run_id", F.lit("a"))
    b = sensors(spark).where("channel < 2").withColumns(
        {"run_id": F.lit("b"), "channel": 1 - F.col("channel"), "scalar_adj": F.lit(2.0)}
    )
    return a.unionByName(b)


def wide(spark, stands, **how):
    numbered = number_batches(with_channels(batches(spark), stands), F.col("nchan"))
    return fleet_wide_scans(numbered, stands, SENSOR_NAMES, RATE, **how)


def test_each_stand_by_its_own_sensors(spark):
    got = wide(spark, stand_sensors(config(spark), SENSOR_NAMES))
    one = number_batches(batches(spark).where("run_id = 'a'"), 5)
    expected = wide_scans(one, sensors(spark).collect(), RATE).select("run_id", "scan_no", *SENSOR_NAMES)
    mine = got.where("run_id = 'a'").select("run_id", "scan_no", *SENSOR_NAMES)
    assert sorted(mine.collect()) == sorted(expected.collect()) and expected.count() == 4
    b = {r.scan_no: r for r in got.where("run_id = 'b'").collect()}
    assert sorted(b) == list(range(1, 14))  # 6 scans of two batches each, and one of the short batch
    volts = [(7 + i) * 10 / 2048 for i in (0, 1)]
    assert b[1]["Chamber Pressure"] == pytest.approx((volts[0] - 9.9951171875) / 4.3 / 4 * 1000 * 2)
    assert b[1]["Load Cell"] == pytest.approx((volts[1] + 8.291015625) * 2)
    assert b[1]["Tank Pressure"] is None and b[1].seconds == 0.1
    raw = wide(spark, stand_sensors(config(spark), SENSOR_NAMES), raw=True).where("run_id = 'b' AND scan_no = 1").first()
    assert [raw["Chamber Pressure"], raw["Load Cell"]] == pytest.approx(volts)


@pytest.mark.parametrize("column, change, message", [
    ("channel", "if(channel = 1, 7, channel)", "do not fit"),
    ("channel", "0", "do not fit"),
    ("sensor_name", "'same'", "do not fit"),
    ("sensor_type", "'sonar'", "sonar"),
    ("run_id", "'a'", "do not fit|no entry"),
])
def test_wrong_configurations_fail(spark, column, change, message):
    stands = stand_sensors(config(spark).withColumn(column, F.expr(change)), SENSOR_NAMES)
    with pytest.raises(Exception, match=message):
        wide(spark, stands).collect()


def test_unknown_stand(spark):
    stands = stand_sensors(config(spark).where("run_id = 'a'"), SENSOR_NAMES)
    with pytest.raises(Exception, match="no entry for run_id: b"):
        wide(spark, stands).collect()
    kept = with_channels(batches(spark), stands, on_unknown="drop")
    numbered = number_batches(kept, F.col("nchan"))
    assert fleet_wide_scans(numbered, stands, SENSOR_NAMES, RATE).count() == 4
