"""Dump files of raw batches: many batches of many runs in one file, which Spark may cut anywhere.

A file is a row of frames as in HDLC-like framing (RFC 1662): a frame ends with the byte 7E, and inside it
7D and 7E are written as 7D 5D and 7D 5E. So 7E never lies inside a frame, the text source splits a file
into byte ranges at it, and a task that starts inside a frame finds the next one. A frame holds its version,
the CRC-32 of what follows, batch id, status, port, the run id and the codes, all little-endian.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thrustlog.schemas import RAW_BATCH

FLAG = "~"  # 7E
VERSION = 1
GUARD = struct.Struct("<BI")  # version, CRC-32 of the rest
HEADER = struct.Struct("<qiiH")  # batch id, status, port, bytes of the run id
FILES_PER_TRIGGER = 50
BATCH_ARROW = pa.schema([
    ("run_id", pa.string()),
    ("batch_id", pa.int64()),
    ("status", pa.int32()),
    ("dport", pa.int32()),
    ("data", pa.list_(pa.int32())),
])


def frame(run_id, batch_id, status, dport, codes):
    """One batch as a stuffed frame without its flag; ``codes`` is an array of whole numbers, or null for none."""
    codes = np.zeros(0, "i4") if codes is None else codes
    if len(codes) and not (0 <= codes.min() and codes.max() <= 0xFFFF):
        raise ValueError(f"batch {batch_id} of run {run_id} has codes beyond 16 bits")
    name = run_id.encode()
    body = HEADER.pack(batch_id, status, dport, len(name)) + name + codes.astype("<u2").tobytes()
    whole = GUARD.pack(VERSION, zlib.crc32(body)) + body
    return whole.replace(b"\x7d", b"\x7d\x5d").replace(b"\x7e", b"\x7d\x5e")


def batch_of(stuffed):
    """Run id, batch id, status, port and codes of a frame; nothing if it is cut short or its bytes changed."""
    whole = stuffed.replace(b"\x7d\x5e", b"\x7e").replace(b"\x7d\x5d", b"\x7d")
    if len(whole) < GUARD.size + HEADER.size or stuffed.endswith(b"\x7d"):
        return None
    version, crc = GUARD.unpack_from(whole)
    if version != VERSION or crc != zlib.crc32(memoryview(whole)[GUARD.size:]):
        return None
    batch_id, status, dport, size = HEADER.unpack_from(whole, GUARD.size)
    start = GUARD.size + HEADER.size
    codes = np.frombuffer(whole, "<u2", offset=start + size)
    return whole[start: start + size].decode(), batch_id, status, dport, codes.astype("i4")


def write_dumps(batches, path, mode="errorifexists"):
    """Write raw batches as dump files, one per partition; null ``data`` is a batch without codes.

    Other nulls, and codes beyond 16 bits, fail the job.
    """

    def encode(tables):
        for table in tables:
            columns = [table.column(c).to_pylist() for c in ("run_id", "batch_id", "status", "dport")]
            lists = table.column("data")
            frames = [
                frame(*row, lists[i].values.to_numpy(zero_copy_only=False) if lists[i].is_valid else None)
                for i, row in enumerate(zip(*columns))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    rows = batches.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_BATCH.fields])
    framed = rows.mapInArrow(encode, "frame binary")
    framed.select(F.col("frame").cast("string")).write.mode(mode).option("lineSep", FLAG).text(path)


def decoded(frames, on_corrupt="fail"):
    """Raw batches of the frames in ``value``. Empty frames hold no batch.

    A frame that was cut short or changed fails the job, or is left out with ``on_corrupt`` "drop".
    """
    if on_corrupt not in ("fail", "drop"):
        raise ValueError(f"on_corrupt is fail or drop, not {on_corrupt}")

    def decode(tables):
        for table in tables:
            found = []
            for value in table.column(0):
                batch = batch_of(value.as_py())
                if batch is not None:
                    found.append(batch)
                elif on_corrupt == "fail":
                    raise ValueError("a frame of the dump is cut short or its bytes changed")
            columns = [list(c) for c in zip(*found)] if found else [[]] * len(BATCH_ARROW)
            ends = np.cumsum([0, *map(len, columns[-1])], dtype="i4")
            codes = np.concatenate([np.zeros(0, "i4"), *columns[-1]])
            plain = [pa.array(c, f.type) for c, f in zip(columns[:-1], BATCH_ARROW)]
            yield pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(ends, codes)], schema=BATCH_ARROW)

    raw = frames.where(F.octet_length("value") > 0).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(decode, RAW_BATCH)


def read_dumps(spark, path, on_corrupt="fail"):
    """Raw batches of dump files; a large file is read by several tasks."""
    return decoded(spark.read.option("lineSep", FLAG).text(path), on_corrupt)


def stream_dumps(spark, path, files_per_trigger=FILES_PER_TRIGGER, on_corrupt="fail"):
    """The same as a stream: at most ``files_per_trigger`` new files per micro-batch."""
    files = spark.readStream.option("lineSep", FLAG).option("maxFilesPerTrigger", files_per_trigger)
    return decoded(files.text(path), on_corrupt)
