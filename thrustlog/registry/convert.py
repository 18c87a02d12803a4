"""Registered conversion and calibration queries with their oracles."""

from pyspark.sql import functions as F

from thrustlog.operators import calibrate as K
from thrustlog.operators import convert as C
from thrustlog.operators.decode import number_batches, readings
from thrustlog.operators.fleet import fleet_wide_scans as wide_of_fleet
from thrustlog.operators.fleet import stand_sensors, with_channels
from thrustlog.registry.views import (
    CHANNELS,
    RATE,
    SENSOR_CONFIG,
    SENSOR_NAMES,
    raw_batches,
    sensors,
    table,
    with_views,
)
from thrustlog.session import shared_folder
from thrustlog.sources.config import config_rows, config_text
from thrustlog.sources.logs import append_log, read_partitioned_log

SHORT = ["load", "chamber_psi", "tank_psi", "tank_c", "chamber_c"]


def numbered(spark, sf_dir):
    return number_batches(raw_batches(spark, sf_dir), CHANNELS)


def converted(spark, sf_dir):
    return C.convert(readings(numbered(spark, sf_dir), CHANNELS, RATE), sensors(spark))


def convert_sensors(spark, sf_dir):
    return converted(spark, sf_dir).select(
        "run_id", "scan_no", "sensor_name", "units", F.round("value", 6).alias("value")
    )


def _short(wide):
    return wide.select(
        "run_id", "scan_no", "seconds",
        *[F.round(F.col(n), 6).alias(s) for n, s in zip(SENSOR_NAMES, SHORT)],
    )


def wide_pivot(spark, sf_dir):
    return _short(C.wide(converted(spark, sf_dir), SENSOR_NAMES))


def wide_scans(spark, sf_dir):
    config = sensors(spark).collect()
    return _short(C.wide_scans(numbered(spark, sf_dir), config, RATE))


def log_roundtrip(spark, sf_dir):
    """Converted log of every run written as CSV per run and read back."""
    config = sensors(spark).collect()
    wide = C.wide_scans(numbered(spark, sf_dir).drop("run_scans"), config, RATE)
    folder = shared_folder(spark, "converted-log")
    append_log(wide.drop("scan_no"), folder)
    back = read_partitioned_log(spark, folder, SENSOR_NAMES).withColumn(
        "run_id", F.col("run_id").cast("long")
    )
    return _short(back.withColumn("scan_no", F.rint(F.col("seconds") * RATE).cast("long")))


def live_feed(spark, sf_dir):
    """Feed of a whole fleet in raw and in converted mode; both modes of a run and sensor share a row of the shuffle."""
    feed = C.live_feed(converted(spark, sf_dir), raw_voltage=None)

    def figures(raw):
        of_mode = F.col("raw") == raw
        y = F.when(of_mode, F.col("y"))
        return F.struct(
            F.lit(raw).alias("raw"), F.count_if(of_mode).alias("points"), F.round(F.min(y), 6).alias("low"),
            F.round(F.max(y), 6).alias("high"),
        )

    per_sensor = feed.groupBy("run_id", "sensor_name").agg(F.array(figures(True), figures(False)).alias("_modes"))
    return per_sensor.select("run_id", "sensor_name", F.inline("_modes"))


def sensor_order(spark, sf_dir):
    """Sensor names in channel order for every run that sent data."""
    names = C.sensor_names(sensors(spark)).select(F.array_join("sensor_names", "|").alias("names"))
    runs = raw_batches(spark, sf_dir).select("run_id").distinct()
    return runs.withColumn("names", names.scalar())


def stand_config(spark, sf_dir):
    """One configuration per customer: the sample, with offsets shifted by the account balance."""
    texts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("stand_id"),
        "c_acctbal",
        F.lit(SENSOR_CONFIG).alias("value"),
    )
    return (
        config_rows(texts)
        .withColumn("linear_adj", F.col("linear_adj") + F.col("c_acctbal"))
        .drop("c_acctbal")
    )


def config_roundtrip(spark, sf_dir):
    """Configurations written as text per stand and read back."""
    texts = config_text(stand_config(spark, sf_dir), ["stand_id"])
    back = config_rows(texts)
    return back.select(
        "stand_id", "sensor_id", "channel", "sensor_name", "sensor_type",
        F.round("linear_adj", 6).alias("linear_adj"), "opamp_mul",
        F.element_at("input", "max_psi").alias("max_psi"),
    )


def mixed_config(spark, sf_dir):
    """Stands of different sensors: a third has three channels only, another its channels the other way round."""
    kind = F.col("run_id") % 3
    return (
        stand_config(spark, sf_dir)
        .withColumn("run_id", F.col("stand_id").cast("long"))
        .where((kind != 0) | (F.col("channel") < 3))
        .withColumn("channel", F.when(kind == 1, F.lit(4) - F.col("channel")).otherwise(F.col("channel")))
    )


def fleet_wide_scans(spark, sf_dir):
    """Wide scans of a whole fleet, each stand by its own configuration."""
    stands = stand_sensors(mixed_config(spark, sf_dir), SENSOR_NAMES)
    batches = number_batches(with_channels(raw_batches(spark, sf_dir), stands), F.col("nchan"))
    return _short(wide_of_fleet(batches, stands, SENSOR_NAMES, RATE))


def references(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("stand_id"),
        (F.lit(60.0) + key % 40).alias("ambient_f"),
        (F.lit(5.0) + key % 20).alias("load_lbs"),
    )


def calibration_run(spark, sf_dir, loaded):
    """Volts of a stand's unloaded run (even batches) or loaded run (odd ones)."""
    wanted = F.col("batch_id") % 2 == (1 if loaded else 0)
    batches = number_batches(raw_batches(spark, sf_dir).where(wanted), CHANNELS)
    return readings(batches, CHANNELS, RATE).select(
        F.col("run_id").alias("stand_id"),
        "channel",
        (F.col("scan_no") - 1).alias("pos"),
        F.col("run_scans").alias("n"),
        "volts",
    )


def interior_stats(spark, sf_dir):
    return K.interior_stats(calibration_run(spark, sf_dir, False), RATE).select(
        "stand_id", "channel", F.round("mean_volts", 6).alias("mean_volts"), "min_volts"
    )


def calibrate_loadcell(spark, sf_dir):
    def on(volts):
        return volts.where(F.col("channel") == 0)

    found = K.calibrate_loadcell(
        on(calibration_run(spark, sf_dir, False)),
        on(calibration_run(spark, sf_dir, True)),
        references(spark, sf_dir),
        RATE,
    )
    return found.select(
        "stand_id", "channel", "linear_adj", F.round("scalar_adj", 6).alias("scalar_adj"),
        F.round("max", 6).alias("max"),
    )


def calibrate_temp(spark, sf_dir):
    volts = calibration_run(spark, sf_dir, False).where(F.col("channel") >= 3)
    found = K.calibrate_temperature(volts, references(spark, sf_dir), RATE, F.lit(4.3))
    return found.select(
        "stand_id", "channel", F.round("linear_adj", 6).alias("linear_adj"), "scalar_adj"
    )


def calibrate_pressure(spark, sf_dir):
    volts = calibration_run(spark, sf_dir, False).where(F.col("channel").isin(1, 2))
    return K.calibrate_pressure(volts, RATE).select(
        "stand_id", "channel", F.round("linear_adj", 6).alias("linear_adj"), "scalar_adj"
    )


def calibrate_config(spark, sf_dir):
    config = stand_config(spark, sf_dir).withColumn("stand_id", F.col("stand_id").cast("long"))
    found = K.calibrate_config(
        config,
        calibration_run(spark, sf_dir, False),
        calibration_run(spark, sf_dir, True),
        references(spark, sf_dir),
        RATE,
    )
    return found.select(
        "stand_id", "channel", "sensor_type", F.round("linear_adj", 6).alias("linear_adj"),
        F.round("scalar_adj", 6).alias("scalar_adj"), F.round("max", 6).alias("max"),
    )


QUERIES = {
    "convert_sensors": convert_sensors,
    "wide_pivot": wide_pivot,
    "wide_scans": wide_scans,
    "fleet_wide_scans": fleet_wide_scans,
    "log_roundtrip": log_roundtrip,
    "live_feed": live_feed,
    "sensor_order": sensor_order,
    "config_roundtrip": config_roundtrip,
    "interior_stats": interior_stats,
    "calibrate_loadcell": calibrate_loadcell,
    "calibrate_temp": calibrate_temp,
    "calibrate_pressure": calibrate_pressure,
    "calibrate_config": calibrate_config,
}

WIDE = with_views("converted") + """
SELECT run_id, scan_no, seconds, """ + ", ".join(
    f"round(max(value) FILTER (channel = {i}), 6) AS {s}" for i, s in enumerate(SHORT)
) + """
FROM converted GROUP BY run_id, scan_no, seconds"""

CALIBRATION = with_views("raw_batches", "sensors") + """,
scans AS (
  SELECT *, coalesce(sum(len // 5) OVER (PARTITION BY run_id, batch_id % 2 ORDER BY batch_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scan_offset,
         sum(len // 5) OVER (PARTITION BY run_id, batch_id % 2) AS n
  FROM raw_batches),
volts AS (
  SELECT run_id AS stand_id, batch_id % 2 AS loaded, scan_offset + i // 5 AS pos, n, CAST(i % 5 AS INTEGER) AS channel,
         (cents % 2048 + i * (1 + run_id % 60) - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE AS volts
  FROM (SELECT *, unnest(range((len // 5) * 5)) AS i FROM scans)),
stats AS (
  SELECT stand_id, channel, loaded, avg(volts) FILTER (pos >= 5 AND pos < n - 5) AS mean_volts,
         min(volts) FILTER (pos >= 5 AND pos < n - 5) AS min_volts
  FROM volts GROUP BY ALL),
refs AS (
  SELECT c_custkey AS stand_id, 60.0::DOUBLE + c_custkey % 40 AS ambient_f,
         (5.0::DOUBLE + c_custkey % 20) * 4.448222::DOUBLE AS force,
         c_acctbal, (((60.0::DOUBLE + c_custkey % 40 - 32) * (5 / 9)) * 0.005::DOUBLE + 1.25::DOUBLE) * 4.3::DOUBLE AS expected
  FROM customer),
masses AS (
  SELECT *, CASE WHEN force * 1.5::DOUBLE % 10 = 0 THEN force * 1.5::DOUBLE
                 ELSE force * 1.5::DOUBLE + 10 - force * 1.5::DOUBLE % 10 END AS top FROM refs)"""

ORACLE = {
    "convert_sensors": with_views("converted") + """
SELECT run_id, scan_no, sensor_name, units, round(value, 6) AS value FROM converted""",
    "wide_pivot": WIDE,
    "wide_scans": WIDE,
    "log_roundtrip": WIDE,
    "fleet_wide_scans": with_views("raw_batches", "sensors") + """,
fleet AS (
  SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 1 THEN 4 - channel ELSE channel END AS channel,
         sensor_name, sensor_type, linear_adj + c_acctbal AS linear_adj, opamp_mul, scalar_adj, max_psi
  FROM customer, sensors WHERE c_custkey % 3 <> 0 OR channel < 3),
widths AS (SELECT run_id, count(*) AS nchan FROM fleet GROUP BY run_id),
placed AS (
  SELECT b.*, nchan, coalesce(sum(len // nchan) OVER (PARTITION BY run_id ORDER BY batch_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scan_offset
  FROM raw_batches b JOIN widths USING (run_id)),
fleet_codes AS (
  SELECT run_id, CAST(scan_offset + i // nchan + 1 AS BIGINT) AS scan_no, i % nchan AS channel,
         (cents % 2048 + i * (1 + run_id % 60) - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE AS volts
  FROM (SELECT *, unnest(range((len // nchan) * nchan)) AS i FROM placed)),
fleet_values AS (
  SELECT run_id, scan_no, sensor_name,
         CASE sensor_type WHEN 'loadcell' THEN (volts + linear_adj) / opamp_mul
              WHEN 'temp' THEN ((volts + linear_adj) / opamp_mul - 1.25) / 0.005::DOUBLE
              ELSE ((volts + linear_adj) / opamp_mul) / 4 * max_psi END * scalar_adj AS value
  FROM fleet_codes JOIN fleet USING (run_id, channel))
SELECT run_id, scan_no, CAST(scan_no AS DOUBLE) / 5 AS seconds, """ + ", ".join(
        f"round(max(value) FILTER (sensor_name = '{n}'), 6) AS {s}" for n, s in zip(SENSOR_NAMES, SHORT)
    ) + """
FROM fleet_values GROUP BY run_id, scan_no""",
    "live_feed": with_views("converted") + """
SELECT run_id, sensor_name, raw, count(*) AS points,
       round(min(CASE WHEN raw THEN volts ELSE value END), 6) AS low,
       round(max(CASE WHEN raw THEN volts ELSE value END), 6) AS high
FROM converted, (VALUES (true), (false)) AS m(raw) GROUP BY ALL""",
    "sensor_order": with_views("raw_batches", "sensors") + """
SELECT DISTINCT run_id, (SELECT string_agg(sensor_name, '|' ORDER BY channel) FROM sensors) AS names
FROM raw_batches""",
    "config_roundtrip": with_views("sensors") + """
SELECT CAST(c_custkey AS VARCHAR) AS stand_id, 'channel' || channel AS sensor_id, channel, sensor_name, sensor_type,
       round(linear_adj + c_acctbal, 6) AS linear_adj, opamp_mul, max_psi
FROM customer, sensors""",
    "interior_stats": CALIBRATION + """
SELECT stand_id, channel, round(mean_volts, 6) AS mean_volts, min_volts FROM stats WHERE loaded = 0""",
    "calibrate_loadcell": CALIBRATION + """
SELECT z.stand_id, channel, 0 - z.min_volts AS linear_adj,
       round(CASE WHEN l.mean_volts <> z.min_volts THEN force / (l.mean_volts - z.min_volts) END, 6) AS scalar_adj,
       round(top, 6) AS max
FROM stats z JOIN stats l USING (stand_id, channel) JOIN masses USING (stand_id)
WHERE z.loaded = 0 AND l.loaded = 1 AND channel = 0""",
    "calibrate_temp": CALIBRATION + """
SELECT stand_id, channel, round(expected - mean_volts, 6) AS linear_adj, 1.0::DOUBLE AS scalar_adj
FROM stats JOIN refs USING (stand_id) WHERE loaded = 0 AND channel >= 3""",
    "calibrate_pressure": CALIBRATION + """
SELECT stand_id, channel, round(0 - mean_volts, 6) AS linear_adj, 1.0::DOUBLE AS scalar_adj
FROM stats WHERE loaded = 0 AND channel IN (1, 2)""",
    "calibrate_config": CALIBRATION + """
SELECT stand_id, channel, sensor_type,
       round(CASE sensor_type WHEN 'loadcell' THEN 0 - z.min_volts WHEN 'temp' THEN expected - z.mean_volts
             ELSE 0 - z.mean_volts END, 6) AS linear_adj,
       round(CASE sensor_type WHEN 'loadcell' THEN CASE WHEN l.mean_volts <> z.min_volts
             THEN force / (l.mean_volts - z.min_volts) END ELSE 1 END, 6) AS scalar_adj,
       round(CASE sensor_type WHEN 'loadcell' THEN top ELSE hi END, 6) AS max
FROM masses CROSS JOIN sensors
LEFT JOIN (SELECT * FROM stats WHERE loaded = 0) z USING (stand_id, channel)
LEFT JOIN (SELECT * FROM stats WHERE loaded = 1) l USING (stand_id, channel)""",
}
