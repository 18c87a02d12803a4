"""Registered scalar functions with their oracles."""

from pyspark.sql import functions as F

from thrustlog.functions import device, rounding, units
from thrustlog.functions.signal import volts
from thrustlog.operators.convert import calibrate_codes
from thrustlog.registry.views import table
from thrustlog.sources.packets import decode_cal_images, with_calibration_time

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "cents", F.round(F.col("l_extendedprice") * 100).cast("long")
    )


def code_volts(spark, sf_dir):
    code = F.col("cents") % 4096
    return items(spark, sf_dir).select(*KEYS, code.alias("code"), volts(code).alias("volts"))


def cal_image_bytes(spark, sf_dir):
    """Calibration memory per supplier; floats are 1 + k/128, whose bits follow from k."""

    def byte(number):
        return F.lpad(F.hex(number.cast("long")), 2, "0")

    key = F.col("s_suppkey")

    def number(k):
        return F.concat(F.lit("0000"), byte(k + 128), F.lit("3F"))

    numbers = [n for c in range(8) for n in (number((key * 3 + c) % 128), number((key * 5 + c) % 128))]
    stamp = [key % 30, key % 12 + 1, key % 28 + 1, key % 24, key % 60, (key * 7) % 60]
    head = F.concat(*numbers, *[byte(b) for b in stamp])
    serial = F.hex(F.encode(F.lpad(key.cast("string"), 8, "0"), "US-ASCII"))
    image = F.concat(F.rpad(head, 2 * 0x2F8, "0"), serial)
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("device_file"), F.unhex(image).alias("content")
    )


def calibration(spark, sf_dir):
    return with_calibration_time(decode_cal_images(cal_image_bytes(spark, sf_dir)))


def calibration_image(spark, sf_dir):
    return calibration(spark, sf_dir).select(
        "device_file", "serial", "channel",
        F.col("slope").cast("double").alias("slope"),
        F.col("intercept").cast("double").alias("intercept"),
    )


def calibration_date(spark, sf_dir):
    return (
        calibration(spark, sf_dir)
        .where(F.col("channel") == 0)
        .select("device_file", F.unix_micros("cal_ts").alias("cal_us"))
    )


def calibrated_code(spark, sf_dir):
    constants = calibration(spark, sf_dir).select(
        F.col("device_file").cast("long").alias("device_id"), "channel", "slope", "intercept"
    )
    rows = items(spark, sf_dir).select(
        *KEYS,
        F.col("l_suppkey").alias("device_id"),
        (F.col("l_linenumber") % 8).alias("channel"),
        (F.col("cents") % 65536 - 2000).cast("int").alias("code"),
    )
    return calibrate_codes(rows, constants).select(*KEYS, "code", "calibrated")


def step_rounding(spark, sf_dir):
    whole = F.col("cents") % 1000 - 500
    price = F.round(F.col("l_extendedprice") - 20000, 2)
    return items(spark, sf_dir).select(
        *KEYS,
        rounding.roundup(whole, 10).alias("up"),
        rounding.rounddown(whole, 10).alias("down"),
        F.round(rounding.roundup(price, 10), 4).alias("price_up"),
        F.round(rounding.rounddown(price, 10), 4).alias("price_down"),
    )


def unit_conversions(spark, sf_dir):
    degrees = units.celsius(F.col("l_quantity") * 2 - 10)
    return items(spark, sf_dir).select(
        *KEYS,
        F.round(degrees, 6).alias("celsius"),
        F.round(units.newtons(F.col("l_quantity")), 6).alias("newtons"),
        F.round(units.expected_temperature_volts(degrees, F.lit(4.3)), 6).alias("volts"),
    )


def batch_exponent(spark, sf_dir):
    rate = F.col("cents")
    return items(spark, sf_dir).select(
        *KEYS,
        rate.alias("rate"),
        device.batch_exponent(rate).alias("exponent"),
        device.batch_scans(rate).alias("scans"),
        device.immediate_transfer(rate % 200).alias("immediate"),
    )


def pacer_rate(spark, sf_dir):
    requested = (F.col("cents") % 1_000_000).cast("double")
    model = F.when(F.col("l_linenumber") % 2 == 0, "205").otherwise("204")
    rate = device.paced_rate(requested, model)
    period = device.pacer_period(rate)
    return items(spark, sf_dir).select(
        *KEYS,
        rate.alias("rate"),
        period.alias("period"),
        F.round(device.actual_rate(period), 6).alias("actual"),
    )


def channel_mask(spark, sf_dir):
    nchan = F.col("l_linenumber") % 9
    return items(spark, sf_dir).select(
        *KEYS,
        device.channel_mask(nchan).alias("mask"),
        device.channel_count(F.col("cents")).cast("int").alias("channels"),
    )


def live_axis(spark, sf_dir):
    low, high = F.col("l_quantity"), F.col("l_extendedprice")
    bottom, top = device.live_axis(low, high)
    raw_bottom, raw_top = device.live_axis(low, high, raw_voltage=True)
    return items(spark, sf_dir).select(
        *KEYS,
        F.round(bottom, 6).alias("bottom"),
        F.round(top, 6).alias("top"),
        raw_bottom.alias("raw_bottom"),
        raw_top.alias("raw_top"),
    )


QUERIES = {
    "volts": code_volts,
    "calibration_image": calibration_image,
    "calibration_date": calibration_date,
    "calibrated_code": calibrated_code,
    "roundup_rounddown": step_rounding,
    "unit_conversions": unit_conversions,
    "batch_exponent": batch_exponent,
    "pacer_rate": pacer_rate,
    "channel_mask": channel_mask,
    "axis_wiggle": live_axis,
}

ITEMS = """WITH items AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"""
SELECT_KEYS = "\nSELECT " + ", ".join(KEYS)

ORACLE = {
    "volts": ITEMS + SELECT_KEYS + """, cents % 4096 AS code,
  (cents % 4096 - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE AS volts FROM items""",
    "calibration_image": """
SELECT CAST(s_suppkey AS VARCHAR) AS device_file, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS serial,
       CAST(channel AS INTEGER) AS channel, 1 + ((s_suppkey * 3 + channel) % 128) / 128.0::DOUBLE AS slope,
       1 + ((s_suppkey * 5 + channel) % 128) / 128.0::DOUBLE AS intercept
FROM supplier, range(8) AS r(channel)""",
    "calibration_date": """
SELECT CAST(s_suppkey AS VARCHAR) AS device_file,
  CASE WHEN s_suppkey % 24 < 23 THEN epoch_us(make_timestamp(2000 + s_suppkey % 30, s_suppkey % 12 + 1,
    s_suppkey % 28 + 1, s_suppkey % 24 + 1, s_suppkey % 60, CAST((s_suppkey * 7) % 60 AS DOUBLE))) END AS cal_us
FROM supplier""",
    "calibrated_code": ITEMS + SELECT_KEYS + """, CAST(cents % 65536 - 2000 AS INTEGER) AS code,
  CAST(least(greatest(round_even((cents % 65536 - 2000)
    * (1 + ((l_suppkey * 3 + l_linenumber % 8) % 128) / 128.0::DOUBLE)
    + (1 + ((l_suppkey * 5 + l_linenumber % 8) % 128) / 128.0::DOUBLE), 0), 0), 65535) AS INTEGER) AS calibrated
FROM items""",
    "roundup_rounddown": ITEMS + """,
stepped AS (
  SELECT *, cents % 1000 - 500 AS x, round(l_extendedprice - 20000, 2) AS p FROM items),
rests AS (
  SELECT *, ((x % 10) + 10) % 10 AS xr, (((x + 1) % 10) + 10) % 10 AS xr1,
         p - 10 * floor(p / 10) AS pr, (p + 1) - 10 * floor((p + 1) / 10) AS pr1 FROM stepped)""" + SELECT_KEYS + """,
  CASE WHEN xr = 0 THEN x ELSE x + 10 - xr END AS up,
  CASE WHEN xr = 0 THEN x ELSE x + 1 - 10 - xr1 END AS down,
  round(CASE WHEN pr = 0 THEN p ELSE p + 10 - pr END, 4) AS price_up,
  round(CASE WHEN pr = 0 THEN p ELSE p + 1 - 10 - pr1 END, 4) AS price_down
FROM rests""",
    "unit_conversions": ITEMS + SELECT_KEYS + """,
  round((l_quantity * 2 - 10 - 32) * (5 / 9), 6) AS celsius, round(l_quantity * 4.448222::DOUBLE, 6) AS newtons,
  round((((l_quantity * 2 - 10 - 32) * (5 / 9)) * 0.005::DOUBLE + 1.25::DOUBLE) * 4.3::DOUBLE, 6) AS volts
FROM items""",
    "batch_exponent": ITEMS + """,
exponents AS (
  SELECT *, (SELECT coalesce(min(x), 20) FROM range(20) AS r(x) WHERE power(2, x) > cents) AS e FROM items)""" + SELECT_KEYS + """,
  cents AS rate, CAST(e AS INTEGER) AS exponent, CAST(power(2, e) AS BIGINT) AS scans,
  CASE WHEN cents % 200 < 100 THEN 1 ELSE 0 END AS immediate
FROM exponents""",
    "pacer_rate": ITEMS + """,
limited AS (
  SELECT *, CAST(CASE WHEN cents % 1000000 > 500000 AND l_linenumber % 2 = 0 THEN 500000
                      WHEN cents % 1000000 > 100000 THEN 100000 ELSE cents % 1000000 END AS DOUBLE) AS rate FROM items),
paced AS (
  SELECT *, CASE WHEN rate > 0 THEN CAST(round_even(70e6 / rate - 1, 0) AS BIGINT) ELSE 0 END AS period FROM limited)""" + SELECT_KEYS + """,
  rate, period, round(CASE WHEN period > 0 THEN 70e6 / (period + 1) END, 6) AS actual
FROM paced""",
    "channel_mask": ITEMS + SELECT_KEYS + """,
  CAST((1 << (l_linenumber % 9)) - 1 AS INTEGER) AS mask, CAST(bit_count(cents & 255) AS INTEGER) AS channels
FROM items""",
    "axis_wiggle": ITEMS + SELECT_KEYS + """,
  round(l_quantity - (l_extendedprice - l_quantity) * 0.10::DOUBLE, 6) AS bottom,
  round(l_extendedprice + (l_extendedprice - l_quantity) * 0.10::DOUBLE, 6) AS top,
  -12.0::DOUBLE AS raw_bottom, 12.0::DOUBLE AS raw_top
FROM items""",
}
