"""Explicit schemas for every table and file the library reads or writes."""

from pyspark.sql import types as T

SENSOR_CONFIG = T.StructType([
    T.StructField("channel", T.IntegerType()),
    T.StructField("sensor_name", T.StringType()),
    T.StructField("sensor_type", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("linear_adj", T.DoubleType()),
    T.StructField("opamp_mul", T.DoubleType()),
    T.StructField("scalar_adj", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("input", T.MapType(T.StringType(), T.DoubleType())),
])
SENSOR_CONFIG_FILE = T.MapType(T.StringType(), SENSOR_CONFIG)

RAW_BATCH = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.IntegerType())),
])

PACKET = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("priority", T.StringType()),
    T.StructField("decoded", T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("requestId", T.LongType()),
    ])),
    T.StructField("ts", T.TimestampType()),
])

SWITCHES = T.StructType([
    T.StructField("remoteid", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ready", T.BooleanType()),
    T.StructField("launch", T.BooleanType()),
    T.StructField("fill", T.BooleanType()),
    T.StructField("dump", T.BooleanType()),
])

CALIBRATION_REFS = T.StructType([
    T.StructField("stand_id", T.StringType()),
    T.StructField("ambient_f", T.DoubleType()),
    T.StructField("load_lbs", T.DoubleType()),
])

CAL_IMAGE_ROW = T.StructType([
    T.StructField("device_file", T.StringType()),
    T.StructField("serial", T.StringType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("slope", T.FloatType()),
    T.StructField("intercept", T.FloatType()),
    T.StructField("date_bytes", T.ArrayType(T.IntegerType())),
])


def wide_log(sensor_names):
    """Schema of a CSV log: seconds, then one double per sensor."""
    return T.StructType(
        [T.StructField("seconds", T.DoubleType())]
        + [T.StructField(name, T.DoubleType()) for name in sensor_names]
    )
