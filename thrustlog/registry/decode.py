"""Registered decode queries with their oracles."""

from pyspark.sql import functions as F

from thrustlog.functions.device import run_label
from thrustlog.operators import decode as D
from thrustlog.operators.convert import append_readings
from thrustlog.registry.views import (
    CHANNELS,
    RATE,
    RUN_SECONDS,
    micros,
    raw_batches,
    table,
    with_views,
)
from thrustlog.sources.packets import decode_codes


def deinterleave(spark, sf_dir):
    return D.deinterleave(raw_batches(spark, sf_dir), CHANNELS).select(
        "run_id", "batch_id", "scan", "channel", "code"
    )


def drop_partial_scan(spark, sf_dir):
    batches = D.dropped_codes(raw_batches(spark, sf_dir), CHANNELS)
    return batches.select(
        "batch_id", D.scans_in(F.col("data"), CHANNELS).alias("scans"), "dropped"
    )


def scan_offset(spark, sf_dir):
    return D.number_batches(raw_batches(spark, sf_dir), CHANNELS).select(
        "run_id", "batch_id", "transfer_no", "scan_offset", "run_scans"
    )


def status_filter(spark, sf_dir):
    return D.non_empty_batches(D.running_batches(raw_batches(spark, sf_dir))).select(
        "run_id", "batch_id", F.size("data").alias("codes")
    )


def overrun_cut(spark, sf_dir):
    return D.until_overrun(D.gate_batches(raw_batches(spark, sf_dir))).select("run_id", "batch_id", "arm_no")


def arm_gate(spark, sf_dir):
    return D.while_armed(D.arm_batches(raw_batches(spark, sf_dir))).select(
        "run_id", "batch_id", "dport", "arm_no"
    )


def runtime_cut(spark, sf_dir):
    numbered = D.number_batches(raw_batches(spark, sf_dir), CHANNELS)
    return D.until_run_time(numbered, RATE, RUN_SECONDS).select("run_id", "batch_id", "scan_offset")


def accepted_batches(spark, sf_dir):
    return D.accepted_batches(raw_batches(spark, sf_dir), CHANNELS, RATE).select(
        "run_id", "arm_no", "batch_id", "transfer_no", "scan_offset"
    )


def first_sample_per_batch(spark, sf_dir):
    first = D.first_samples(raw_batches(spark, sf_dir), CHANNELS)
    return first.select(
        "run_id", "batch_id", *[F.col("volts")[i].alias(f"v{i}") for i in range(CHANNELS)]
    )


def batch_transfer_stats(spark, sf_dir):
    batches = raw_batches(spark, sf_dir)
    return D.transfer_report(batches, CHANNELS, RATE, "ts", "ts")


def readings_volts(spark, sf_dir):
    batches = D.number_batches(raw_batches(spark, sf_dir), CHANNELS)
    return D.readings(batches, CHANNELS, RATE).select(
        "run_id", "scan_no", "seconds", "channel", "volts"
    )


def packet_bytes(spark, sf_dir):
    """Batches as the device sends them: two bytes a code, low byte first."""

    def byte(code):
        return F.lpad(F.hex(code.cast("long")), 2, "0")

    text = F.array_join(
        F.transform("data", lambda c: F.concat(byte(c % 256), byte(F.floor(c / 256)))), ""
    )
    return raw_batches(spark, sf_dir).select(
        "run_id", "batch_id", F.unhex(text).alias("content")
    )


def packet_decode(spark, sf_dir):
    batches = decode_codes(packet_bytes(spark, sf_dir))
    return D.deinterleave(batches, CHANNELS).select(
        "run_id", "batch_id", "scan", "channel", "code"
    )


def concat_batches(spark, sf_dir):
    """Even and odd batches as two appended parts."""
    rows = D.deinterleave(raw_batches(spark, sf_dir), CHANNELS).select(
        "run_id", "batch_id", "scan", "channel", "code"
    )
    odd = F.col("batch_id") % 2 == 1
    both = append_readings(rows.where(~odd), rows.where(odd))
    return both.groupBy("run_id", "channel").agg(
        F.count("*").alias("rows"), F.sum(F.col("code").cast("long")).alias("code_sum")
    )


def run_labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts")
    return orders.select("o_orderkey", micros("ts"), run_label(F.col("ts")).alias("label"))


QUERIES = {
    "deinterleave": deinterleave,
    "drop_partial_scan": drop_partial_scan,
    "scan_offset": scan_offset,
    "status_filter": status_filter,
    "overrun_cut": overrun_cut,
    "arm_gate": arm_gate,
    "runtime_cut": runtime_cut,
    "accepted_batches": accepted_batches,
    "first_sample_per_batch": first_sample_per_batch,
    "batch_transfer_stats": batch_transfer_stats,
    "readings_volts": readings_volts,
    "packet_decode": packet_decode,
    "concat_batches": concat_batches,
    "run_labels": run_labels,
}

CODES = with_views("codes") + """
SELECT run_id, batch_id, scan, channel, code FROM codes"""

GATED = """ports AS (
  SELECT *, lag(dport, 1, 0) OVER (PARTITION BY run_id ORDER BY batch_id) AS port_before FROM raw_batches),
armed AS (
  SELECT *, CAST(sum(CASE WHEN dport <> 0 AND port_before = 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY run_id ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arm_no
  FROM ports),
gated AS (
  SELECT *, sum(CASE WHEN status & 4 <> 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY run_id, arm_no ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS overruns
  FROM armed WHERE dport <> 0 OR port_before <> 0)"""

ACCEPTED = GATED + """,
stored AS (
  SELECT * FROM gated WHERE overruns = 0 AND status = 2 AND len > 0),
accepted AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, arm_no ORDER BY batch_id) AS transfer_no,
         CAST(coalesce(sum(len // 5) OVER (PARTITION BY run_id, arm_no ORDER BY batch_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan_offset
  FROM stored)"""

ORACLE = {
    "deinterleave": CODES,
    "packet_decode": CODES,
    "drop_partial_scan": with_views("raw_batches") + """
SELECT batch_id, len // 5 AS scans, CAST(len % 5 AS INTEGER) AS dropped FROM raw_batches""",
    "scan_offset": with_views("numbered") + """
SELECT run_id, batch_id, transfer_no, scan_offset,
       CAST(sum(len // 5) OVER (PARTITION BY run_id) AS BIGINT) AS run_scans FROM numbered""",
    "status_filter": with_views("raw_batches") + """
SELECT run_id, batch_id, CAST(len AS INTEGER) AS codes FROM raw_batches WHERE status = 2 AND len > 0""",
    "overrun_cut": with_views("raw_batches") + ",\n" + GATED + """
SELECT run_id, batch_id, arm_no FROM gated WHERE overruns = 0""",
    "arm_gate": with_views("raw_batches") + ",\n" + GATED + """
SELECT run_id, batch_id, dport, arm_no FROM gated""",
    "runtime_cut": with_views("numbered") + """
SELECT run_id, batch_id, scan_offset FROM numbered WHERE scan_offset / 5.0 <= 4""",
    "accepted_batches": with_views("raw_batches") + ",\n" + ACCEPTED + """
SELECT run_id, arm_no, batch_id, transfer_no, scan_offset FROM accepted""",
    "first_sample_per_batch": with_views("codes") + """
SELECT run_id, batch_id, """ + ", ".join(
        f"max((code - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE) FILTER (channel = {i}) AS v{i}"
        for i in range(CHANNELS)
    ) + """
FROM codes WHERE scan = 0 GROUP BY run_id, batch_id""",
    "batch_transfer_stats": with_views("raw_batches") + """,
totals AS (
  SELECT run_id, count(*) AS transfers, CAST(sum(len // 5) AS BIGINT) AS points,
         max(len // 5) AS largest_batch, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS wall,
         sum(len // 5) / 5.0::DOUBLE AS recorded
  FROM raw_batches GROUP BY run_id)
SELECT run_id, transfers, points, largest_batch, wall AS wall_sec, CAST(trunc(wall / 60) AS BIGINT) AS wall_min,
       CAST(trunc(recorded) AS BIGINT) AS recorded_sec, CAST(trunc(recorded / 60) AS BIGINT) AS recorded_min,
       CAST(trunc(wall - recorded) AS BIGINT) AS drift_sec
FROM totals""",
    "readings_volts": with_views("readings") + """
SELECT run_id, scan_no, seconds, channel, volts FROM readings""",
    "concat_batches": with_views("codes") + """
SELECT run_id, channel, count(*) AS rows, CAST(sum(code) AS BIGINT) AS code_sum FROM codes GROUP BY run_id, channel""",
    "run_labels": """
SELECT o_orderkey, epoch_us(o_orderdate) AS ts_us, strftime(o_orderdate, '%y-%b-%d_%H:%M:%S') AS label FROM orders""",
}
