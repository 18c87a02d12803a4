"""Wide scans of stands that each have a sensor configuration of their own."""

from pyspark.sql import functions as F

from thrustlog.functions.formulas import FORMULA_INPUTS, engineering_value
from thrustlog.functions.signal import scan_seconds
from thrustlog.operators.convert import checked_config
from thrustlog.operators.decode import scan_volts
from thrustlog.plans.lookup import lookup_join

SENSOR = ["channel", "sensor_name", "sensor_type", "linear_adj", "opamp_mul", "scalar_adj"]


def input_names():
    return sorted({name for names in FORMULA_INPUTS.values() for name in names})


def stand_sensors(config, names, key="run_id"):
    """One row per stand: ``nchan``, its ``sensors`` in channel order, and in ``places`` the place of each of ``names``.

    ``config`` has ``key`` and a row per channel. The channels of a stand are 0 to ``nchan`` - 1; a gap, a
    channel given twice or a name given twice fails the query.
    """
    fields = [*SENSOR, *[f"_input_{name}" for name in input_names()]]
    stands = checked_config(config).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("sensors")
    )
    counted = F.sequence(F.lit(0), F.size("sensors") - 1)
    fits = (F.col("sensors.channel") == counted) & (
        F.size(F.array_distinct("sensors.sensor_name")) == F.size("sensors")
    )
    refuse = F.raise_error(F.concat(F.lit("channels or sensor names do not fit at stand "), F.col(key).cast("string")))
    return stands.where(F.coalesce(fits, F.lit(False)) | refuse.cast("boolean")).select(
        key,
        F.size("sensors").alias("nchan"),
        "sensors",
        F.array(*[F.array_position("sensors.sensor_name", name).cast("int") for name in names]).alias("places"),
    )


def with_channels(batches, stands, key="run_id", on_unknown="fail"):
    """Add ``nchan``, which numbering needs; the sensors stay out of its shuffle."""
    return lookup_join(batches, stands.select(key, "nchan"), [key], on_unknown)


def fleet_wide_scans(numbered, stands, names, frequency, key="run_id", raw=False, on_unknown="fail"):
    """One row per scan with a column per sensor name, null where the stand has no such sensor.

    ``numbered`` are batches from ``with_channels`` after numbering, ``stands`` comes from ``stand_sensors`` with the
    same ``names``. Sensors join the batch, not the reading, and the formulas run over the volts of a scan side by side, so
    there is no row per reading and no pivot. ``frequency`` is a number or a column. ``raw`` leaves volts. Batches of a
    stand without sensors fail the query, or give no scans with ``on_unknown`` "null" or "drop".
    """
    joined = lookup_join(numbered, stands.drop("nchan"), [key], on_unknown)
    scans = scan_volts(joined, F.col("nchan"))

    def value(v, sensor):
        inputs = {name: sensor[f"_input_{name}"] for name in input_names()}
        return engineering_value(
            v, sensor["sensor_type"], sensor["linear_adj"], sensor["opamp_mul"], sensor["scalar_adj"], inputs, on_unknown
        )

    values = F.col("volts") if raw else F.zip_with("volts", "sensors", value)
    scan_no = F.col("scan_offset") + F.col("scan") + 1
    kept = [c for c in ("arm_no", "run_scans", "rate") if c in numbered.columns]
    valued = scans.select(
        *dict.fromkeys(["run_id", key]), *kept, scan_no.alias("scan_no"), scan_seconds(scan_no, frequency).alias("seconds"),
        "places", values.alias("_values"),
    )
    return valued.select(
        *[c for c in valued.columns if c not in ("places", "_values")],
        *[F.get("_values", F.col("places")[i] - 1).alias(name) for i, name in enumerate(names)],
    )
