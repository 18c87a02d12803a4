"""Scalar functions on hand-worked values."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thrustlog.functions import device, formulas, motor, rounding, signal, units


def values(spark, inputs, column, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.r for r in df.select("i", column(F.col("x")).alias("r")).orderBy("i").collect()]


def test_volts(spark):
    assert values(spark, [0, 2048, 4095], signal.volts, "int") == [-10.0, 0.0, 2047 * 10 / 2048]


def test_step_rounding(spark):
    assert values(spark, [15, 20, -3, 0], lambda x: rounding.roundup(x, 10), "int") == [20, 20, 0, 0]
    got = values(spark, [15, 19, -3, 20], lambda x: rounding.rounddown(x, 10), "int")
    assert got == [0, 10, -20, 20]


def test_fixed_equals_exact_text(spark):
    rng = random.Random(1)
    inputs = [0.125, 0.375, 2.675, 1.005, 0.995, 9.995, 0.0, -0.001, -2.5, 0.5, 1.5, 123456.785, 0.045]
    inputs += [rng.uniform(-1000, 1000) for _ in range(200)]
    for places in (1, 2):
        got = values(spark, inputs, lambda x: rounding.fixed(x, places))
        assert got == [f"{v:.{places}f}" for v in inputs]


def test_calibrated_code_rounds_half_even_and_clamps(spark):
    got = values(
        spark, [1, 3, -50, 90000],
        lambda x: signal.calibrated_code(x, F.lit(0.5), F.lit(0.0)), "int",
    )
    assert got == [0, 2, 0, 45000]
    assert values(spark, [70000], lambda x: signal.calibrated_code(x, F.lit(1.0), F.lit(0.0)), "int") == [65535]


def test_clip_keeps_null(spark):
    assert values(spark, [-1.0, None, 2.0], signal.clip_below_zero) == [0.0, None, 2.0]


def test_units(spark):
    assert values(spark, [32.0, 212.0], units.celsius) == pytest.approx([0, 100])
    assert values(spark, [10.0], units.newtons) == pytest.approx([44.48222])
    got = values(spark, [25.0], lambda x: units.expected_temperature_volts(x, F.lit(4.3)))
    assert got == pytest.approx([5.9125])


def test_batch_exponent(spark):
    inputs = [0, 1, 2, 3, 4, 1000, 1023, 1024, 2**19 - 1, 2**19, 2**25]
    got = values(spark, inputs, device.batch_exponent, "long")
    assert got == [next((x for x in range(20) if 2**x > f), 20) for f in inputs]


def test_pacer(spark):
    df = spark.createDataFrame(
        [(600000.0, "205"), (500000.0, "205"), (600000.0, "204"), (5000.0, "204"), (0.0, "204")],
        "f double, m string",
    )
    rate = device.paced_rate(F.col("f"), F.col("m"))
    rows = df.select(rate.alias("r"), device.pacer_period(rate).alias("p")).collect()
    assert [(r.r, r.p) for r in rows] == [
        (500000.0, 139), (100000.0, 699), (100000.0, 699), (5000.0, 13999), (0.0, 0),
    ]


def test_channels(spark):
    assert values(spark, [0, 3, 8], device.channel_mask, "int") == [0, 7, 255]
    assert values(spark, [0, 7, 255, 256], device.channel_count, "int") == [0, 3, 8, 0]


def test_calibration_time(spark):
    def at(hour):
        return device.calibration_time(F.lit(21), F.lit(5), F.lit(6), hour, F.lit(8), F.lit(9))

    got = values(spark, [7, 23], lambda x: F.date_format(at(x), "yyyy-MM-dd HH:mm:ss"), "int")
    assert got == ["2021-05-06 08:08:09", None]


@pytest.mark.parametrize("impulse, letter, over", [
    (0.0, "Unknown", False), (0.3125, "Unknown", False), (0.32, "1/4A", False), (2.5, "A", False),
    (2.51, "B", False), (40960.0, "O", False), (40961.0, "1/8A", True), (None, "Unknown", False),
])
def test_motor_class(spark, impulse, letter, over):
    assert values(spark, [impulse], motor.motor_class) == [letter]
    assert values(spark, [impulse], motor.class_overflow) == [over]


def test_designation_truncates(spark):
    assert values(spark, [47.9], lambda x: motor.designation(F.lit("I"), x)) == ["I47"]


SENSORS = "t string, v double, i map<string,double>"


def engineering(df, **options):
    return df.select(
        formulas.engineering_value(
            F.col("v"), F.col("t"), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.col("i"), **options
        ).alias("r")
    )


def test_formulas(spark):
    df = spark.createDataFrame(
        [("loadcell", 3.0, {}), ("temp", 3.0, {}), ("pressure", 3.0, {"max_psi": 100.0})], SENSORS
    )
    assert [r.r for r in engineering(df).collect()] == pytest.approx([6.0, 450.0, 150.0])


def test_unknown_type(spark):
    df = spark.createDataFrame([("humidity", 3.0, {})], SENSORS)
    with pytest.raises(PySparkException):
        engineering(df).collect()
    assert engineering(df, on_unknown="null").first().r is None


def test_added_formula(spark):
    formulas.register_formula("flow", lambda v, inputs: v * inputs["area"], ["area"])
    try:
        df = spark.createDataFrame([("flow", 3.0, {"area": 5.0})], SENSORS)
        assert engineering(df).first().r == 30.0
    finally:
        del formulas.FORMULAS["flow"], formulas.FORMULA_INPUTS["flow"]


def test_inputs_must_fit(spark):
    df = spark.createDataFrame([("loadcell", 3.0, {"max_psi": 1.0})], SENSORS)
    with pytest.raises(PySparkException):
        df.select(formulas.inputs_checked(F.col("t"), F.col("i"))).collect()


def test_labels(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-05 10:20:30' AS ts")
    row = df.select(
        device.run_label(F.col("ts")).alias("a"), device.recording_name("cam", F.col("ts")).alias("b")
    ).first()
    assert (row.a, row.b) == ("24-Jan-05_10:20:30", "cam-1704450030.h264")
