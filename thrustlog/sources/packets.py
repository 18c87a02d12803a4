"""Binary dumps from the device, and message packets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thrustlog.constants import (
    CAL_DATE_OFFSET,
    DEVICE_CHANNELS,
    SERIAL_LENGTH,
    SERIAL_OFFSET,
)
from thrustlog.functions.device import calibration_time
from thrustlog.schemas import CAL_IMAGE_ROW, PACKET

DAMAGED = "_damaged"


def decode_codes(packets, content="content"):
    """Replace a binary column by ``data``, its little-endian 16-bit codes."""
    others = [f for f in packets.schema.fields if f.name != content]
    schema = T.StructType(others + [T.StructField("data", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in others]

    def decode(batches):
        for batch in batches:
            lists = []
            for buffer in batch.column(content):
                raw = buffer.as_py()
                if raw is None:
                    lists.append(None)
                else:
                    lists.append(np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<u2").astype("i4"))
            data = pa.array(lists, type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [data], names=names + ["data"]
            )

    return packets.select(*names, content).mapInArrow(decode, schema)


def read_packet_dumps(spark, path):
    """One raw batch per dump file ``<run>/<batch number>.bin``; an empty file holds no batch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    place = F.url_decode(F.col("path"))
    named = files.select(
        F.regexp_extract(place, r"([^/]+)/[^/]+$", 1).alias("run_id"),
        F.regexp_extract(place, r"(\d+)\.bin$", 1).cast("long").alias("batch_id"),
        "content",
    )
    return decode_codes(named)


def decode_cal_images(images, name="device_file", content="content"):
    """Slope and intercept per channel, with serial and date bytes, from calibration memory."""

    def decode(batches):
        for batch in batches:
            rows = []
            for device, raw in zip(batch.column(name).to_pylist(), batch.column(content).to_pylist()):
                pairs = np.frombuffer(raw, dtype="<f4", count=2 * DEVICE_CHANNELS).reshape(-1, 2)
                serial = raw[SERIAL_OFFSET: SERIAL_OFFSET + SERIAL_LENGTH].decode("ascii", "replace")
                stamp = list(raw[CAL_DATE_OFFSET: CAL_DATE_OFFSET + 6])
                rows += [
                    {
                        "device_file": device,
                        "serial": serial,
                        "channel": channel,
                        "slope": float(slope),
                        "intercept": float(intercept),
                        "date_bytes": stamp,
                    }
                    for channel, (slope, intercept) in enumerate(pairs)
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=CAL_ARROW)

    return images.select(name, content).mapInArrow(decode, CAL_IMAGE_ROW)


CAL_ARROW = pa.schema([
    ("device_file", pa.string()),
    ("serial", pa.string()),
    ("channel", pa.int32()),
    ("slope", pa.float32()),
    ("intercept", pa.float32()),
    ("date_bytes", pa.list_(pa.int32())),
])


def with_calibration_time(decoded):
    parts = [F.element_at("date_bytes", i + 1) for i in range(6)]
    return decoded.withColumn("cal_ts", calibration_time(*parts)).drop("date_bytes")


def read_cal_images(spark, path):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return with_calibration_time(
        decode_cal_images(files.select(F.col("path").alias("device_file"), "content"))
    )


def read_packets(spark, path):
    """Message packets, one JSON object per line."""
    return spark.read.schema(PACKET).json(path)


def stream_packets(spark, path, files_per_batch=50):
    """The same as a stream; a line that is no packet comes whole in ``_damaged``."""
    schema = T.StructType([*PACKET.fields, T.StructField(DAMAGED, T.StringType())])
    files = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", DAMAGED)
    return files.option("maxFilesPerTrigger", files_per_batch).json(path)
