"""Sensor constants from calibration runs.

``volts`` tables are long readings with ``pos`` and ``n`` per run and channel; reference values
(ambient temperature, calibration mass) are columns of a small table keyed by ``stand_id``.
"""

from pyspark.sql import functions as F

from thrustlog.functions.rounding import roundup
from thrustlog.functions.units import celsius, expected_temperature_volts, newtons
from thrustlog.operators.analysis import interior


def interior_stats(volts, f, keys=("stand_id", "channel")):
    """Mean and minimum of the volts per sensor, first and last second left out."""
    kept = F.when(interior(F.col("pos"), F.col("n"), f), F.col("volts"))
    return volts.groupBy(*keys).agg(F.avg(kept).alias("mean_volts"), F.min(kept).alias("min_volts"))


def calibrate_loadcell(no_load, loaded, references, f, keys=("stand_id", "channel")):
    """Offset from the unloaded run, gain from the loaded one, range from the mass.

    Equal readings with and without load leave the gain null.
    """
    zero = interior_stats(no_load, f, keys).select(*keys, F.col("min_volts").alias("min_no_load"))
    load = interior_stats(loaded, f, keys).select(*keys, F.col("mean_volts").alias("mean_load"))
    force = newtons(F.col("load_lbs"))
    return (
        zero.join(load, list(keys))
        .join(references, "stand_id")
        .select(
            *keys,
            (F.lit(0.0) - F.col("min_no_load")).alias("linear_adj"),
            F.try_divide(force, F.col("mean_load") - F.col("min_no_load")).alias("scalar_adj"),
            roundup(force * F.lit(1.5), 10).alias("max"),
        )
    )


def calibrate_temperature(no_load, references, f, opamp_mul, keys=("stand_id", "channel")):
    """Offset that makes the mean reading show the ambient temperature; gain 1."""
    expected = expected_temperature_volts(celsius(F.col("ambient_f")), opamp_mul)
    return (
        interior_stats(no_load, f, keys)
        .join(references, "stand_id")
        .select(
            *keys,
            (expected - F.col("mean_volts")).alias("linear_adj"),
            F.lit(1.0).alias("scalar_adj"),
        )
    )


def calibrate_pressure(no_load, f, keys=("stand_id", "channel")):
    """Offset that makes the mean reading show zero pressure; gain 1."""
    return interior_stats(no_load, f, keys).select(
        *keys,
        (F.lit(0.0) - F.col("mean_volts")).alias("linear_adj"),
        F.lit(1.0).alias("scalar_adj"),
    )


def calibrate_config(config, no_load, loaded, references, f):
    """New configuration of every stand: ``config`` is keyed by ``stand_id, channel``."""
    keys = ("stand_id", "channel")
    zero = interior_stats(no_load, f, keys).select(
        *keys, "mean_volts", F.col("min_volts").alias("min_no_load")
    )
    load = interior_stats(loaded, f, keys).select(*keys, F.col("mean_volts").alias("mean_load"))
    measured = (
        config.join(zero, list(keys), "left")
        .join(load, list(keys), "left")
        .join(references, "stand_id", "left")
    )
    kind = F.col("sensor_type")
    force = newtons(F.col("load_lbs"))
    expected = expected_temperature_volts(celsius(F.col("ambient_f")), F.col("opamp_mul"))
    linear = (
        F.when(kind == "loadcell", F.lit(0.0) - F.col("min_no_load"))
        .when(kind == "temp", expected - F.col("mean_volts"))
        .when(kind == "pressure", F.lit(0.0) - F.col("mean_volts"))
        .otherwise(F.col("linear_adj"))
    )
    scalar = (
        F.when(kind == "loadcell", F.try_divide(force, F.col("mean_load") - F.col("min_no_load")))
        .when(kind.isin("temp", "pressure"), F.lit(1.0))
        .otherwise(F.col("scalar_adj"))
    )
    top = F.when(kind == "loadcell", roundup(force * F.lit(1.5), 10)).otherwise(F.col("max"))
    return measured.withColumns({"linear_adj": linear, "scalar_adj": scalar, "max": top}).select(
        *config.columns
    )
