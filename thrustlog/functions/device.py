"""Run metadata that follows from the device settings."""

from pyspark.sql import functions as F

from thrustlog.constants import (
    FAST_MODEL,
    FAST_MODEL_RATE_LIMIT_HZ,
    IMMEDIATE_BELOW_HZ,
    PACED_RATE_LIMIT_HZ,
    PACER_CLOCK_HZ,
    RAW_AXIS_LIMIT,
)


def batch_exponent(frequency):
    """Least x in 0..19 with 2^x above the frequency, else 20: the bit length of its whole part."""
    bits = F.length(F.bin(F.floor(frequency).cast("long")))
    return (
        F.when(frequency < 1, F.lit(0))
        .when(frequency >= F.lit(2**19), F.lit(20))
        .otherwise(bits)
        .cast("int")
    )


def batch_scans(frequency):
    return F.pow(F.lit(2.0), batch_exponent(frequency)).cast("long")


def paced_rate(requested, model):
    """Requested rate after the device limits."""
    return (
        F.when(
            (requested > F.lit(FAST_MODEL_RATE_LIMIT_HZ)) & (model == FAST_MODEL),
            F.lit(FAST_MODEL_RATE_LIMIT_HZ),
        )
        .when(requested > F.lit(PACED_RATE_LIMIT_HZ), F.lit(PACED_RATE_LIMIT_HZ))
        .otherwise(requested.cast("double"))
    )


def pacer_period(rate):
    """Timer period; 0 means an external clock."""
    return (
        F.when(rate > 0, F.rint(F.lit(PACER_CLOCK_HZ) / rate - F.lit(1)))
        .otherwise(F.lit(0.0))
        .cast("long")
    )


def actual_rate(period):
    """Rate the timer really gives; null with an external clock."""
    return F.when(period > 0, F.lit(PACER_CLOCK_HZ) / (period + F.lit(1)))


def immediate_transfer(frequency):
    return F.when(frequency < F.lit(IMMEDIATE_BELOW_HZ), F.lit(1)).otherwise(F.lit(0))


def channel_mask(nchan):
    return F.pow(F.lit(2.0), nchan).cast("int") - F.lit(1)


def channel_count(mask):
    return F.bit_count(mask.bitwiseAND(F.lit(255)))


def calibration_time(year, month, day, hour, minute, second):
    """Years count from 2000 and the stored hour is one short; an impossible date is null."""
    return F.try_make_timestamp(
        year + F.lit(2000), month, day, hour + F.lit(1), minute, second
    )


def live_axis(low, high, raw_voltage=False):
    """Lower and upper limit of the live view."""
    if raw_voltage:
        return F.lit(-RAW_AXIS_LIMIT), F.lit(RAW_AXIS_LIMIT)
    room = (high - low) * F.lit(0.10)
    return low - room, high + room


def drift_report(wall_seconds, recorded_seconds):
    """Whole seconds and minutes of both clocks and their difference."""
    minute = F.lit(60)
    return {
        "wall_sec": wall_seconds.cast("long"),
        "wall_min": (wall_seconds / minute).cast("long"),
        "recorded_sec": recorded_seconds.cast("long"),
        "recorded_min": (recorded_seconds / minute).cast("long"),
        "drift_sec": (wall_seconds - recorded_seconds).cast("long"),
    }


def run_label(start):
    return F.date_format(start, "yy-MMM-dd_HH:mm:ss")


def recording_name(prefix, start):
    return F.format_string("%s-%d.h264", F.lit(prefix), F.unix_seconds(start))
