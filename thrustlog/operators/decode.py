"""Raw batches to scans, codes and volts.

A raw batch is one row with its interleaved codes as an array (``schemas.RAW_BATCH``), so cutting
it into scans is a projection and needs no shuffle.
"""

from pyspark.sql import functions as F

from thrustlog.constants import SCAN_OVERRUN, SCAN_RUNNING
from thrustlog.functions.device import actual_rate, drift_report, paced_rate, pacer_period
from thrustlog.functions.signal import scan_seconds, volts
from thrustlog.operators import gates
from thrustlog.plans.lookup import lookup_join
from thrustlog.plans.scan import (
    integer_div,
    key_total,
    number_block,
    previous_value,
    running,
    running_sum,
)


ARM = ["run_id", "arm_no"]


def scans_in(data, nchan):
    """Whole scans in a batch; codes of an incomplete last scan do not count."""
    return F.coalesce(integer_div(F.size(data), nchan), F.lit(0).cast("long"))


def running_batches(batches):
    """Batches read while the device reports running and nothing else."""
    return batches.where(F.col("status") == SCAN_RUNNING)


def non_empty_batches(batches):
    return batches.where(F.size("data") > 0)


def overrun(status):
    return status.bitwiseAND(F.lit(SCAN_OVERRUN)) != 0


def arm_batches(batches, block_width=1024):
    """Add ``armed_before``, 1 where the port was non-zero with the previous batch of the run, and
    ``arm_no``, how often the run has been armed so far."""
    block = number_block(F.col("batch_id"), block_width)
    armed = (F.col("dport") != 0).cast("int")
    before = running(batches, ["run_id"], ["batch_id"], block, armed_before=previous_value(armed))
    return running(before, ["run_id"], ["batch_id"], block, arm_no=running_sum(arming().cast("long")))


def arming():
    """The port goes non-zero; a device that was never read counts as not armed."""
    return (F.col("dport") != 0) & (F.coalesce(F.col("armed_before"), F.lit(0)) == 0)


def while_armed(armed):
    """Keep batches while the port is non-zero, and the one read together with the first zero."""
    return armed.where((F.col("dport") != 0) | (F.coalesce(F.col("armed_before"), F.lit(0)) == 1))


def count_overruns(kept, block_width=1024):
    """Add ``overruns``, the overrun reports so far since the run was last armed."""
    block = number_block(F.col("batch_id"), block_width)
    overruns = running_sum(overrun(F.col("status")).cast("long"))
    return running(kept, ARM, ["batch_id"], block, overruns=overruns)


def gate_batches(batches, block_width=1024):
    """Batches read while armed, with ``arm_no`` and ``overruns``."""
    return count_overruns(while_armed(arm_batches(batches, block_width)), block_width)


def number_batches(batches, nchan, block_width=1024, keys=("run_id",), scans=None):
    """Add ``transfer_no``, ``scan_offset`` (scans of earlier batches) and ``run_scans`` (of all)."""
    scans = scans_in(F.col("data"), nchan) if scans is None else scans
    return running(
        batches,
        list(keys),
        ["batch_id"],
        number_block(F.col("batch_id"), block_width),
        transfer_no=running_sum(F.lit(1).cast("long")),
        scan_offset=running_sum(scans, exclusive=True),
        run_scans=key_total(scans),
    )


def with_rates(batches, runs, nchan):
    """Add each run's ``rate`` and the ``real_rate`` that the device's timer gives it.

    ``runs`` has one row per run: ``run_id``, the requested samples a second and channel ``rate``, and the device's ``model``.
    The timer paces all channels together; with an external clock (no period) the requested rate stands. A run without
    a row fails the query.
    """
    period = pacer_period(paced_rate(F.col("rate") * F.lit(nchan), F.col("model")))
    real = F.coalesce(actual_rate(period) / F.lit(nchan), F.col("rate").cast("double"))
    return lookup_join(batches, runs.select("run_id", "rate", real.alias("real_rate")), ["run_id"])


def until_overrun(gated):
    """An overrun ends what was armed: keep what came before the first one."""
    return gated.where(F.col("overruns") == 0)


def until_run_time(numbered, frequency, max_seconds):
    """Stop after the first batch that ends beyond ``max_seconds``; 0 means no limit.

    A cut run no longer has the length in ``run_scans``, so that column goes.
    """
    if not max_seconds:
        return numbered
    return numbered.where(
        scan_seconds(F.col("scan_offset"), frequency) <= F.lit(float(max_seconds))
    ).drop("run_scans")


def accepted_batches(batches, nchan, frequency, max_seconds=0):
    """Batches the logger would have stored, numbered: gates first, then the time axis.

    Each arming starts a time axis of its own, told apart by ``arm_no``. All gates and numbers come from one scan
    (``operators.gates``): the batches move once, and one narrow pass over them sums up their blocks.
    """
    rows = gates.in_blocks(batches, nchan)
    return until_run_time(gates.accepted(rows, gates.composed(gates.pieces(rows))), frequency, max_seconds)


def deinterleave(batches, nchan):
    """One row per code: element ``i`` is channel ``i mod nchan`` of scan ``i div nchan``."""
    return (
        batches.select("*", F.posexplode("data").alias("_i", "code"))
        .where(F.col("_i") < scans_in(F.col("data"), nchan) * nchan)
        .withColumn("scan", integer_div(F.col("_i"), nchan))
        .withColumn("channel", F.pmod(F.col("_i"), F.lit(nchan)))
        .drop("data", "_i")
    )


def dropped_codes(batches, nchan):
    """Codes of each batch that the incomplete last scan loses."""
    return batches.withColumn(
        "dropped", (F.size("data") - scans_in(F.col("data"), nchan) * nchan).cast("int")
    )


def readings(numbered, nchan, frequency):
    """Long form of numbered batches: run, batch, scan number, seconds, channel, code, volts.

    ``run_scans``, ``arm_no`` and ``rate`` stay where the batches have them; ``frequency`` may be a column.
    """
    scan_no = F.col("scan_offset") + F.col("scan") + 1
    length = [c for c in ("run_scans", "arm_no", "rate") if c in numbered.columns]
    return deinterleave(numbered, nchan).select(
        "run_id",
        "batch_id",
        scan_no.alias("scan_no"),
        scan_seconds(scan_no, frequency).alias("seconds"),
        "channel",
        "code",
        volts(F.col("code")).alias("volts"),
        *length,
    )


def scan_volts(batches, nchan):
    """One row per whole scan with its volts as an array in channel order; no shuffle."""
    scan = F.explode(F.sequence(F.lit(0).cast("long"), scans_in(F.col("data"), nchan) - 1))
    values = F.transform(
        F.slice(F.col("data"), (F.col("scan") * nchan + 1).cast("int"), F.lit(nchan)),
        volts,
    )
    return (
        batches.where(scans_in(F.col("data"), nchan) > 0)
        .withColumn("scan", scan)
        .withColumn("volts", values)
        .drop("data")
    )


def first_samples(batches, nchan):
    """Volts of the first scan of every batch that has one."""
    return batches.where(scans_in(F.col("data"), nchan) > 0).select(
        "run_id",
        "batch_id",
        F.transform(F.slice("data", 1, nchan), volts).alias("volts"),
    )


def transfer_report(batches, nchan, frequency, start_ts="start_ts", end_ts="end_ts"):
    """Per run: transfers, points, recorded seconds, and the drift against the wall clock."""
    points = F.sum(scans_in(F.col("data"), nchan))
    wall = F.unix_seconds(F.max(end_ts)) - F.unix_seconds(F.min(start_ts))
    report = batches.groupBy("run_id").agg(
        F.count("*").alias("transfers"),
        points.alias("points"),
        F.max(scans_in(F.col("data"), nchan)).alias("largest_batch"),
        wall.cast("double").alias("_wall"),
    )
    recorded = scan_seconds(F.col("points"), frequency)
    return report.select(
        "run_id",
        "transfers",
        "points",
        "largest_batch",
        *[c.alias(name) for name, c in drift_report(F.col("_wall"), recorded).items()],
    )
