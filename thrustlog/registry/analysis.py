"""Registered analysis queries with their oracles."""

from pyspark.sql import functions as F

from thrustlog.functions.motor import class_overflow, motor_class
from thrustlog.operators import analysis as A
from thrustlog.operators.convert import convert, wide_scans
from thrustlog.operators.decode import accepted_batches, number_batches, readings, with_rates
from thrustlog.plans.per_run import run_keys
from thrustlog.registry.decode import ACCEPTED
from thrustlog.registry.views import (
    CHANNELS,
    RATE,
    SENSOR_NAMES,
    raw_batches,
    run_settings,
    sensors,
    trace,
    with_views,
)
from thrustlog.session import shared_folder, stored_table
from thrustlog.sources.dumps import read_dumps, write_dumps
from thrustlog.sources.logs import (
    append_log,
    melt,
    read_log,
    read_partitioned_log,
    read_raw_log,
    read_reports,
    write_processed,
    write_reports,
)


def rounded(*names, digits=6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def stored_trace(spark, sf_dir):
    """The trace, stored once because every detector pass reads it."""
    return stored_table(trace(spark, sf_dir), "trace")


def detected(spark, sf_dir):
    return A.detect_burn(stored_trace(spark, sf_dir), RATE, stored_table)


def cut(spark, sf_dir, margin=0.0):
    rows = stored_trace(spark, sf_dir)
    return A.cut_trace(rows, RATE, margin, burn=A.detect_burn(rows, RATE, stored_table))


def burn_start(spark, sf_dir):
    return detected(spark, sf_dir).select("run_id", "n", *rounded("starting_min", "test_max", "start_t"))


def burn_end(spark, sf_dir):
    return detected(spark, sf_dir).select("run_id", *rounded("ending_min", "end_t"))


def zeroed_trace(spark, sf_dir):
    return A.zero_thrust(stored_trace(spark, sf_dir), RATE).select("run_id", "pos", *rounded("t", "y"))


def zeroed_cut_trace(spark, sf_dir):
    return cut(spark, sf_dir).select("run_id", "pos", "n", *rounded("t", "y"))


def margin_cut_trace(spark, sf_dir):
    return cut(spark, sf_dir, 5).select("run_id", "pos", "n", *rounded("t", "y"))


def short_margin_cut_trace(spark, sf_dir):
    """A margin so short that rows are cut on both sides of the burn."""
    return cut(spark, sf_dir, 0.25).select("run_id", "pos", "n", *rounded("t", "y"))


def impulse(spark, sf_dir):
    return A.impulse_and_thrust(cut(spark, sf_dir), RATE).select("run_id", "kept", *rounded("impulse"))


def average_thrust(spark, sf_dir):
    return A.impulse_and_thrust(cut(spark, sf_dir), RATE).select("run_id", *rounded("average_thrust"))


def cumulative_impulse(spark, sf_dir):
    rows = stored_table(cut(spark, sf_dir), "cut")
    return A.cumulative_impulse(rows, RATE).select("run_id", "pos", *rounded("t", "impulse"))


def motor_classes(spark, sf_dir):
    scaled = F.col("impulse") * F.pow(F.lit(10.0), F.col("run_id") % 7 - 4)
    return A.impulse_and_thrust(cut(spark, sf_dir), RATE).select(
        "run_id",
        motor_class(scaled).alias("motor_class"),
        class_overflow(scaled).alias("class_overflow"),
    )


def burn_time(spark, sf_dir):
    rows = stored_table(cut(spark, sf_dir), "cut")
    return A.burn_time(rows, RATE).select("run_id", *rounded("start_time", "end_time", "burn_time"))


SUMMARY_NUMBERS = [
    "impulse", "average_thrust", "burn_time", "start_time", "end_time", "burn_time_first_pass",
]


def rounded_summary(summary, digits=6):
    return summary.select(
        *run_keys(summary), "motor_class", "designation", *rounded(*SUMMARY_NUMBERS, digits=digits), "class_overflow"
    )


def run_summary(spark, sf_dir):
    return rounded_summary(A.run_summary(stored_trace(spark, sf_dir), RATE, stored_table))


def summary_text(spark, sf_dir):
    return A.summary_text(run_summary(spark, sf_dir)).withColumnRenamed("value", "report")


def converted(spark, sf_dir):
    batches = number_batches(raw_batches(spark, sf_dir), CHANNELS)
    return convert(readings(batches, CHANNELS, RATE), sensors(spark))


def wide_log(spark, sf_dir):
    """Wide scans of the raw batches, stored once because every detector pass reads them."""
    batches = number_batches(raw_batches(spark, sf_dir), CHANNELS)
    wide = wide_scans(batches, sensors(spark).collect(), RATE)
    return stored_table(wide, "wide-log")


def thrust_trace(spark, sf_dir):
    """Thrust trace of the raw batches, stored once because every detector pass reads it."""
    batches = number_batches(raw_batches(spark, sf_dir), CHANNELS)
    config = sensors(spark).collect()
    wide = wide_scans(batches, config, RATE, only=["Load Cell"])
    return stored_table(A.trace_from_wide(wide), "thrust-trace")


def batch_run_summary(spark, sf_dir):
    """Codes to summary."""
    return rounded_summary(A.run_summary(thrust_trace(spark, sf_dir), RATE, stored_table))


def summary_of_accepted(spark, batches):
    """Codes to summary of what the logger would have stored, one row per arming of a run."""
    wide = wide_scans(accepted_batches(batches, CHANNELS, RATE), sensors(spark).collect(), RATE, only=["Load Cell"])
    rows = stored_table(A.trace_from_wide(wide), "gated-trace")
    return rounded_summary(A.run_summary(rows, RATE, stored_table))


def gated_run_summary(spark, sf_dir):
    return summary_of_accepted(spark, raw_batches(spark, sf_dir))


def dump_run_summary(spark, sf_dir):
    """The same from dump files: bytes to batches, stored since the gates read them twice, then scans and summary."""
    folder = shared_folder(spark, "dumps")
    write_dumps(raw_batches(spark, sf_dir), folder)
    batches = stored_table(read_dumps(spark, folder), "dumped")
    return summary_of_accepted(spark, batches.withColumn("run_id", F.col("run_id").cast("long")))


def mixed_rate_summary(spark, sf_dir):
    """Codes to summary of runs of different rates in one table, on the time axis of the device's real rate.

    Eight digits, as ticks of the device's clock lie half-way between two numbers of six.
    """
    runs = run_settings(spark, sf_dir)
    batches = number_batches(with_rates(raw_batches(spark, sf_dir), runs, CHANNELS), CHANNELS)
    wide = wide_scans(batches, sensors(spark).collect(), F.col("real_rate"), only=["Load Cell"])
    rows = stored_table(A.trace_from_wide(wide), "mixed-trace")
    return rounded_summary(A.run_summary(rows, F.col("rate"), stored_table), 8)


def readings_run_summary(spark, sf_dir):
    """The same from long converted readings."""
    rows = stored_table(
        A.trace_from_readings(converted(spark, sf_dir).drop("run_scans")), "thrust-trace"
    )
    return rounded_summary(A.run_summary(rows, RATE, stored_table))


def processed(spark, sf_dir, margin=5):
    """Processed wide trace of every run."""
    wide = wide_log(spark, sf_dir)
    burn = A.detect_burn(A.trace_from_wide(wide), RATE, stored_table)
    return A.margin_log(wide.withColumn("pos", F.col("scan_no") - 1), burn, margin)


def axis_bounds(spark, sf_dir):
    kept = A.report_extremes(processed(spark, sf_dir), SENSOR_NAMES)
    return A.report_axis(kept, sensors(spark)).select(
        "run_id", "sensor_name", *rounded("axis_min", "axis_max")
    )


def processed_trace(spark, sf_dir):
    return melt(processed(spark, sf_dir), SENSOR_NAMES).select("run_id", "sensor_name", *rounded("seconds", "value"))


def stored_log(spark, sf_dir, purpose, raw=False):
    """Logs of every run written as CSV, a folder per run, and read back by their folders' names."""
    batches = number_batches(raw_batches(spark, sf_dir), CHANNELS).drop("run_scans")
    wide = wide_scans(batches, sensors(spark).collect(), RATE, raw=raw)
    folder = shared_folder(spark, purpose)
    append_log(wide.drop("scan_no"), folder)
    read = read_raw_log if raw else read_log
    return read(spark, folder, SENSOR_NAMES, file_name="*.csv")


def whole_ids(rows):
    return rows.withColumn("run_id", F.col("run_id").cast("long"))


def log_run_summary(spark, sf_dir):
    """Stored logs to summary."""
    rows = stored_table(A.trace_from_log(whole_ids(stored_log(spark, sf_dir, "log"))), "log-trace")
    return rounded_summary(A.run_summary(rows, RATE, stored_table))


def raw_log_roundtrip(spark, sf_dir):
    log = whole_ids(stored_log(spark, sf_dir, "raw-log", raw=True))
    return log.select("run_id", *rounded("seconds"), *[F.round(F.col(n), 6).alias(f"v{i}") for i, n in enumerate(SENSOR_NAMES)])


def processed_log(spark, sf_dir):
    """Stored logs to processed traces with a margin of one second, written, replaced and read back."""
    placed = stored_table(A.placed_log(stored_log(spark, sf_dir, "log")), "placed-log")
    trace_of = placed.select("run_id", "pos", "n", F.col("seconds").alias("t"), F.col("Load Cell").alias("y"))
    burn = A.detect_burn(trace_of, RATE, stored_table)
    folder = shared_folder(spark, "processed")
    for margin in (5, 1):
        write_processed(A.margin_log(placed, burn, margin), folder)
    back = whole_ids(read_partitioned_log(spark, folder, SENSOR_NAMES))
    return back.select("run_id", *rounded("seconds"), *[F.round(F.col(n), 6).alias(f"y{i}") for i, n in enumerate(SENSOR_NAMES)])


def reports_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "reports")
    write_reports(A.summary_text(run_summary(spark, sf_dir)), folder)
    return whole_ids(read_reports(spark, folder)).withColumnRenamed("value", "report")




QUERIES = {
    "burn_start": burn_start,
    "burn_end": burn_end,
    "zeroed_trace": zeroed_trace,
    "zeroed_cut_trace": zeroed_cut_trace,
    "margin_cut_trace": margin_cut_trace,
    "short_margin_cut_trace": short_margin_cut_trace,
    "impulse": impulse,
    "average_thrust": average_thrust,
    "cumulative_impulse": cumulative_impulse,
    "motor_class": motor_classes,
    "burn_time": burn_time,
    "run_summary": run_summary,
    "summary_text": summary_text,
    "batch_run_summary": batch_run_summary,
    "gated_run_summary": gated_run_summary,
    "dump_run_summary": dump_run_summary,
    "readings_run_summary": readings_run_summary,
    "mixed_rate_summary": mixed_rate_summary,
    "axis_bounds": axis_bounds,
    "processed_trace": processed_trace,
    "log_run_summary": log_run_summary,
    "raw_log_roundtrip": raw_log_roundtrip,
    "processed_log": processed_log,
    "reports_roundtrip": reports_roundtrip,
}


def detection(source, prefix, f="5"):
    """Views that detect the burn in ``source``, step by step as the definition reads."""
    p = prefix
    return f"""{p}limits AS (
  SELECT run_id, max(n) AS n,
         min(y) FILTER (pos >= {f} AND pos < 2 * {f}) AS starting_min,
         max(y) FILTER (pos >= {f} AND pos < n - {f}) AS test_max,
         min(y) FILTER (pos >= greatest(n - 2 * {f}, 0) AND pos < n - {f}) AS ending_min
  FROM {source} GROUP BY run_id),
{p}start AS (
  SELECT run_id, coalesce(min(t) FILTER (y > (test_max - starting_min) * 0.10 + starting_min), min(t)) AS start_t
  FROM {source} JOIN {p}limits USING (run_id) GROUP BY run_id),
{p}burn AS (
  SELECT l.run_id, any_value(l.n) AS n, any_value(starting_min) AS starting_min,
         any_value(test_max) AS test_max, any_value(ending_min) AS ending_min,
         any_value(start_t) AS start_t,
         coalesce(max(t) FILTER (t > start_t + 0.01
                  AND y > (test_max - ending_min) * 0.05 + ending_min), max(t)) AS end_t
  FROM {source} s JOIN {p}limits l USING (run_id) JOIN {p}start USING (run_id) GROUP BY l.run_id)"""


def cutting(source, burn, name, margin=0, carried=""):
    return f"""{name} AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS pos,
         count(*) OVER (PARTITION BY run_id) AS n, round(t - start_t + {margin}, 4) AS t, y - starting_min AS y{carried}
  FROM (SELECT s.run_id, t, y, start_t, starting_min{carried} FROM {source} s JOIN {burn} b USING (run_id)
        WHERE t > start_t - {margin} AND t < end_t + {margin}))"""


def summary_views(f="5"):
    return f"""figures AS (
  SELECT run_id, sum(area) AS impulse, avg(clipped) AS average_thrust, count(*) AS kept
  FROM (SELECT run_id, CASE WHEN y IS NOT NULL THEN greatest(y, 0) END AS clipped,
               (greatest(y, 0) + lag(greatest(y, 0)) OVER (PARTITION BY run_id ORDER BY pos)) / 2 / {f} AS area,
        FROM cut) GROUP BY run_id),
classed AS (
  SELECT run_id, average_thrust, kept, CASE WHEN average_thrust IS NOT NULL THEN coalesce(impulse, 0) END AS impulse
  FROM figures)"""

CLASS_LADDER = """CASE
    WHEN {x} <= 0.3125 OR {x} IS NULL THEN 'Unknown' WHEN {x} <= 0.625 THEN '1/4A' WHEN {x} <= 1.25 THEN '1/2A'
    WHEN {x} <= 2.5 THEN 'A' WHEN {x} <= 5 THEN 'B' WHEN {x} <= 10 THEN 'C' WHEN {x} <= 20 THEN 'D'
    WHEN {x} <= 40 THEN 'E' WHEN {x} <= 80 THEN 'F' WHEN {x} <= 160 THEN 'G' WHEN {x} <= 320 THEN 'H'
    WHEN {x} <= 640 THEN 'I' WHEN {x} <= 1280 THEN 'J' WHEN {x} <= 2560 THEN 'K' WHEN {x} <= 5120 THEN 'L'
    WHEN {x} <= 10240 THEN 'M' WHEN {x} <= 20480 THEN 'N' WHEN {x} <= 40960 THEN 'O' ELSE '1/8A' END"""


def analysed(source_views, source="trace", f="5", carried=""):
    return ",\n".join([
        source_views,
        detection(source, "first_", f),
        cutting(source, "first_burn", "cut", carried=carried),
        detection("cut", "again_", f),
        summary_views(f),
    ])


EVENTS = analysed(with_views("trace"))
THRUST_TRACE = with_views("converted") + """,
thrust AS (
  SELECT run_id, scan_no - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n, seconds AS t, value AS y
  FROM converted WHERE sensor_name = 'Load Cell')"""
BATCHES = analysed(THRUST_TRACE, "thrust")

# Every arming is a run, named by a struct.
GATED_BATCHES = analysed(with_views("raw_batches", "sensors") + ",\n" + ACCEPTED + """,
scans AS (
  SELECT *, sum(len // 5) OVER (PARTITION BY run_id, arm_no) AS n FROM accepted),
thrust AS (
  SELECT {'run': run_id, 'arm': arm_no} AS run_id, scan_offset + scan AS pos, n,
         CAST(scan_offset + scan + 1 AS DOUBLE) / 5 AS t,
         ((cents % 2048 + 5 * scan * (1 + run_id % 60) - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE + linear_adj)
           / opamp_mul * scalar_adj AS y
  FROM (SELECT *, unnest(range(len // 5)) AS scan FROM scans), sensors WHERE channel = 0)""", "thrust")

# Every run has its own rate; the timer paces five channels, and none of the rates reaches its limits.
MIXED_BATCHES = analysed(with_views("raw_batches", "numbered", "codes", "sensors") + """,
settings AS (SELECT c_custkey AS run_id, 3 + c_nationkey % 5 AS rate FROM customer),
thrust AS (
  SELECT run_id, pos, count(*) OVER (PARTITION BY run_id) AS n,
         (pos + 1) / (70000000 / (round_even(70000000 / (rate * 5) - 1, 0) + 1) / 5) AS t,
         ((code - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE + linear_adj) / opamp_mul * scalar_adj AS y, rate
  FROM (SELECT c.run_id, scan_offset + scan AS pos, code FROM codes c JOIN numbered USING (run_id, batch_id) WHERE channel = 0)
       JOIN settings USING (run_id), sensors WHERE channel = 0)""", "thrust", "rate", ", rate")

SUMMARY = """summary AS (
  SELECT b.run_id,
         CASE WHEN average_thrust IS NOT NULL THEN """ + CLASS_LADDER.format(x="impulse") + """ END AS motor_class,
         impulse, average_thrust, a.end_t - a.start_t AS burn_time, a.start_t AS start_time, a.end_t AS end_time,
         b.end_t - b.start_t AS burn_time_first_pass, coalesce(impulse > 40960, false) AS class_overflow
  FROM first_burn b LEFT JOIN classed USING (run_id) LEFT JOIN again_burn a USING (run_id))"""

SELECT_SUMMARY = """
SELECT run_id, motor_class, motor_class || CAST(trunc(average_thrust) AS BIGINT) AS designation,
       round(impulse, 6) AS impulse, round(average_thrust, 6) AS average_thrust,
       round(burn_time, 6) AS burn_time, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time,
       round(burn_time_first_pass, 6) AS burn_time_first_pass, class_overflow
FROM summary"""

def around(margin):
    return BATCHES + f""",
around AS (
  SELECT c.run_id, round(seconds - (start_t - {margin}), 4) AS seconds, sensor_name, channel,
         CASE WHEN sensor_name = 'Load Cell' THEN value - starting_min ELSE value END AS value
  FROM converted c JOIN first_burn USING (run_id)
  WHERE seconds > start_t - {margin} AND seconds < end_t + {margin})"""


AROUND = around(5)

REPORT_TEXT = """E'\\n        Motor: ' || motor_class || CAST(trunc(average_thrust) AS BIGINT) ||
  E'  \\n        Impulse: ' || printf('%.2f', round(impulse, 6)) || E' Ns  \\n        Average Thrust: ' ||
  printf('%.2f', round(average_thrust, 6)) || E' N  \\n        Burn Time: ' || printf('%.1f', round(burn_time, 6)) ||
  E' s  \\n        Start Time: ' || printf('%.1f', round(start_time, 6)) || E' s  \\n        End Time: ' ||
  printf('%.1f', round(end_time, 6)) || E' s  \\n        '"""


def across(prefix, value="value"):
    return ", ".join(f"round(max({value}) FILTER (channel = {i}), 6) AS {prefix}{i}" for i in range(CHANNELS))


GATED_SUMMARY = GATED_BATCHES + ",\n" + SUMMARY + f"""
SELECT run_id.run AS run_id, run_id.arm AS arm_no, COLUMNS(* EXCLUDE (run_id)) FROM ({SELECT_SUMMARY})"""

ORACLE = {
    "burn_start": EVENTS + """
SELECT run_id, n, round(starting_min, 6) AS starting_min, round(test_max, 6) AS test_max,
       round(start_t, 6) AS start_t FROM first_burn""",
    "burn_end": EVENTS + """
SELECT run_id, round(ending_min, 6) AS ending_min, round(end_t, 6) AS end_t FROM first_burn""",
    "zeroed_trace": EVENTS + """
SELECT run_id, pos, round(t, 6) AS t, round(y - starting_min, 6) AS y FROM trace JOIN first_limits USING (run_id)""",
    "zeroed_cut_trace": EVENTS + """
SELECT run_id, pos, n, round(t, 6) AS t, round(y, 6) AS y FROM cut""",
    "margin_cut_trace": EVENTS + ",\n" + cutting("trace", "first_burn", "wide_cut", 5) + """
SELECT run_id, pos, n, round(t, 6) AS t, round(y, 6) AS y FROM wide_cut""",
    "short_margin_cut_trace": EVENTS + ",\n" + cutting("trace", "first_burn", "wide_cut", 0.25) + """
SELECT run_id, pos, n, round(t, 6) AS t, round(y, 6) AS y FROM wide_cut""",
    "impulse": EVENTS + """
SELECT run_id, kept, round(impulse, 6) AS impulse FROM classed""",
    "average_thrust": EVENTS + """
SELECT run_id, round(average_thrust, 6) AS average_thrust FROM classed""",
    "cumulative_impulse": EVENTS + """
SELECT run_id, pos, round(t, 6) AS t, round(coalesce(sum(area) OVER (PARTITION BY run_id ORDER BY pos), 0), 6) AS impulse
FROM (SELECT *, (greatest(y, 0) + lag(greatest(y, 0)) OVER (PARTITION BY run_id ORDER BY pos)) / 2 / 5 AS area FROM cut)""",
    "motor_class": EVENTS + """
SELECT run_id, """ + CLASS_LADDER.format(x="scaled") + """ AS motor_class, coalesce(scaled > 40960, false) AS class_overflow
FROM (SELECT run_id, impulse * power(10.0, run_id % 7 - 4) AS scaled FROM classed)""",
    "burn_time": EVENTS + """
SELECT run_id, round(start_t, 6) AS start_time, round(end_t, 6) AS end_time, round(end_t - start_t, 6) AS burn_time
FROM again_burn""",
    "run_summary": EVENTS + ",\n" + SUMMARY + SELECT_SUMMARY,
    "summary_text": EVENTS + ",\n" + SUMMARY + f"""
SELECT run_id, {REPORT_TEXT} AS report FROM summary""",
    "reports_roundtrip": EVENTS + ",\n" + SUMMARY + f"""
SELECT run_id, {REPORT_TEXT} AS report FROM summary WHERE motor_class IS NOT NULL""",
    "log_run_summary": BATCHES + ",\n" + SUMMARY + SELECT_SUMMARY,
    "raw_log_roundtrip": with_views("readings") + f"""
SELECT run_id, round(seconds, 6) AS seconds, {across('v', 'volts')} FROM readings GROUP BY run_id, seconds""",
    "processed_log": around(1) + f"""
SELECT run_id, round(seconds, 6) AS seconds, {across('y')} FROM around GROUP BY run_id, seconds""",
    "batch_run_summary": BATCHES + ",\n" + SUMMARY + SELECT_SUMMARY,
    "gated_run_summary": GATED_SUMMARY,
    "dump_run_summary": GATED_SUMMARY,
    "mixed_rate_summary": MIXED_BATCHES + ",\n" + SUMMARY + SELECT_SUMMARY.replace(", 6)", ", 8)"),
    "readings_run_summary": BATCHES + ",\n" + SUMMARY + SELECT_SUMMARY,
    "axis_bounds": AROUND + """,
stepped AS (
  SELECT run_id, sensor_name, max(value) AS high, min(value) AS low FROM around GROUP BY ALL),
modded AS (
  SELECT *, high - 10 * floor(high / 10) AS high_rest, low - 10 * floor(low / 10) AS low_rest,
         low + 1 - 10 * floor((low + 1) / 10) AS next_rest FROM stepped),
bounded AS (
  SELECT run_id, m.sensor_name,
         CASE WHEN m.sensor_name = 'Load Cell' THEN -1
              ELSE coalesce(CASE WHEN low_rest = 0 THEN low ELSE low + 1 - 10 - next_rest END, lo) END AS axis_min,
         coalesce(CASE WHEN high_rest = 0 THEN high ELSE high + 10 - high_rest END, hi) AS top
  FROM modded m JOIN sensors s USING (sensor_name))
SELECT run_id, sensor_name, round(axis_min, 6) AS axis_min,
       round(CASE WHEN axis_min = top THEN top + 10 ELSE top END, 6) AS axis_max FROM bounded""",
    "processed_trace": AROUND + """
SELECT run_id, sensor_name, round(seconds, 6) AS seconds, round(value, 6) AS value FROM around""",
}
