"""Sensor configuration files."""

from pyspark.sql import functions as F

from thrustlog.schemas import SENSOR_CONFIG, SENSOR_CONFIG_FILE


def config_rows(texts, text="value"):
    """One row per sensor from configuration texts; other columns of ``texts`` are kept."""
    others = [c for c in texts.columns if c != text]
    parsed = F.from_json(F.col(text), SENSOR_CONFIG_FILE, {"mode": "FAILFAST"})
    return texts.select(*others, F.explode(parsed).alias("sensor_id", "_sensor")).select(
        *others, "sensor_id", "_sensor.*"
    )


def read_config(spark, path):
    return config_rows(spark.read.text(path, wholetext=True))


def config_text(config, keys=()):
    """Configuration text per stand, sensors and fields in sorted order.

    The list collected per stand holds one entry per device channel.
    """
    fields = sorted(f.name for f in SENSOR_CONFIG.fields)
    entry = F.struct("sensor_id", F.struct(*fields).alias("cfg"))

    def by_id(a, b):
        return F.when(a["sensor_id"] < b["sensor_id"], -1).otherwise(1)

    document = F.map_from_entries(F.array_sort(F.collect_list(entry), by_id))
    return config.groupBy(*keys).agg(F.to_json(document, {"pretty": "true"}).alias("value"))


def write_config(config, path):
    config_text(config).write.mode("overwrite").text(path)
