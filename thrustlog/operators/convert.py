"""Volts to engineering units by sensor configuration, long or wide."""

from pyspark.sql import functions as F

from thrustlog.functions.formulas import FORMULA_INPUTS, engineering_value, inputs_checked
from thrustlog.functions.signal import calibrated_code, scan_seconds
from thrustlog.operators.decode import scan_volts
from thrustlog.plans.lookup import lookup_join
from thrustlog.plans.per_run import run_keys


def _input_names():
    return sorted({name for names in FORMULA_INPUTS.values() for name in names})


def checked_config(config):
    """Configuration whose formula inputs fit its sensor types, each input as a column.

    Both the check and the look-up happen on this small table, not on every reading.
    """
    checked = config.withColumn("input", inputs_checked(F.col("sensor_type"), F.col("input")))
    return checked.withColumns(
        {f"_input_{name}": F.element_at("input", name) for name in _input_names()}
    ).drop("input")


def convert(readings, config, keys=("channel",), on_unknown="fail"):
    """Add sensor name, units and engineering value to long readings.

    One stand's configuration joins by channel; that of a fleet by ``("stand_id", "channel")``. A channel
    or a sensor type that is not known fails, or gives null with ``on_unknown`` "null".

    One stand has at most one row per device channel, so it is broadcast by hand. Spark does not know the size of
    a configuration made in the session, and takes that of readings for the size of their batches, which hold them
    as arrays: left alone it broadcasts the readings, or shuffles them by a handful of channels.
    """
    columns = readings.columns
    checked = checked_config(config)
    if list(keys) == ["channel"]:
        checked = F.broadcast(checked)
    joined = lookup_join(readings, checked, keys, on_unknown)
    value = engineering_value(
        F.col("volts"),
        F.col("sensor_type"),
        F.col("linear_adj"),
        F.col("opamp_mul"),
        F.col("scalar_adj"),
        {name: F.col(f"_input_{name}") for name in _input_names()},
        on_unknown,
    )
    return joined.select(*columns, "sensor_name", "units", value.alias("value"))


def calibrate_codes(readings, device_calibration, keys=("device_id", "channel"), on_unknown="fail"):
    """Add the device-calibrated code; a device or channel without a table fails, or gives null."""
    return (
        lookup_join(readings, device_calibration, keys, on_unknown)
        .withColumn(
            "calibrated", calibrated_code(F.col("code"), F.col("slope"), F.col("intercept"))
        )
        .drop("slope", "intercept")
    )


def sensor_names(config):
    """Sensor names in channel order, as one array row."""
    return config.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("channel", "sensor_name"))),
            lambda s: s["sensor_name"],
        ).alias("sensor_names")
    )


def wide(converted, names, value="value", keys=None):
    """Long to wide: one column per sensor name, given in channel order.

    ``keys`` are those of a scan: run, ``arm_no`` where the readings have it, scan number and seconds. The readings of
    a scan meet in one row before the shuffle; ``pivot`` would move each of them, by scan and sensor. Of several values of
    a sensor in one scan any that is not null counts.
    """
    keys = [*run_keys(converted), "scan_no", "seconds"] if keys is None else keys
    sensor = F.col("sensor_name")
    return converted.groupBy(*keys).agg(
        *[F.first(F.when(sensor == name, F.col(value)), ignorenulls=True).alias(name) for name in names]
    )


def wide_scans(numbered, config_rows, frequency, raw=False, only=None, on_unknown="fail"):
    """Wide readings straight from numbered batches, without a shuffle.

    All channels of a scan lie side by side in the batch, so no pivot is needed.
    ``config_rows`` are the rows of one stand's configuration, at most one per device channel;
    ``only`` names the sensors to convert. ``run_scans``, ``arm_no`` and ``rate`` stay where
    the batches have them. ``frequency`` is a number or a column of the batches, such as a run's real rate.
    """
    ordered = sorted(config_rows, key=lambda row: row["channel"])
    scans = scan_volts(numbered, len(ordered))
    length = [c for c in ("run_scans", "arm_no", "rate") if c in numbered.columns]
    scan_no = F.col("scan_offset") + F.col("scan") + 1

    def column(sensor):
        v = F.element_at("volts", sensor["channel"] + 1)
        if not raw:
            given = sensor["input"] or {}
            if set(given) != set(FORMULA_INPUTS.get(sensor["sensor_type"], given)):
                raise ValueError(f"inputs do not fit the formula of {sensor['sensor_type']}")
            v = engineering_value(
                v,
                F.lit(sensor["sensor_type"]),
                F.lit(sensor["linear_adj"]),
                F.lit(sensor["opamp_mul"]),
                F.lit(sensor["scalar_adj"]),
                {name: F.lit(given.get(name)).cast("double") for name in _input_names()},
                on_unknown,
            )
        return v.alias(sensor["sensor_name"])

    return scans.select(
        "run_id",
        scan_no.alias("scan_no"),
        scan_seconds(scan_no, frequency).alias("seconds"),
        *[column(s) for s in ordered if only is None or s["sensor_name"] in only],
        *length,
    )


def live_feed(converted, raw_voltage=False):
    """Rows for the live view: volts in raw mode, engineering units otherwise.

    With ``raw_voltage`` None both, from one pass over the readings; ``raw`` tells them apart.
    """
    keys = ["run_id", "scan_no", "seconds", "sensor_name"]
    if raw_voltage is None:
        modes = [(True, "volts"), (False, "value")]
        return converted.select(*keys, F.inline(F.array(*[F.struct(F.lit(raw).alias("raw"), F.col(c).alias("y")) for raw, c in modes])))
    chosen = F.col("volts") if raw_voltage else F.col("value")
    return converted.select(*keys, chosen.alias("y"))


def append_readings(accumulated, batch):
    """Bag union by column name."""
    return accumulated.unionByName(batch)
