"""Dump files of many batches: bytes, cuts, damage, bounded intake."""

import glob

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PythonException

from thrustlog.schemas import RAW_BATCH
from thrustlog.session import stored_table
from thrustlog.sources import dumps
from thrustlog.streaming.carried import run_stream

AWKWARD = [0x7E7E, 0x7D7D, 0x7D5D, 0x5E7D, 0x5D7D, 0x0A0D, 0xBBEF, 0xFFFF, 0]


def rows_of(df):
    return sorted((r.run_id, r.batch_id, r.status, r.dport, tuple(r.data)) for r in df.collect())


def batches(spark, count):
    rows = [
        (f"run~}}{i % 3}é", i * 0x7E7D, 0x7E if i % 2 else 2, 0x7D, [AWKWARD[(i + k) % 9] for k in range(i % 40)])
        for i in range(count)
    ]
    return spark.createDataFrame(rows, RAW_BATCH)


@given(
    st.text(max_size=5), st.integers(-(2**63), 2**63 - 1), st.integers(0, 255), st.integers(0, 255),
    st.lists(st.sampled_from(AWKWARD) | st.integers(0, 0xFFFF), max_size=12),
)
def test_frame(run_id, batch_id, status, dport, codes):
    stuffed = dumps.frame(run_id, batch_id, status, dport, np.array(codes, "i4"))
    assert b"\x7e" not in stuffed
    *head, back = dumps.batch_of(stuffed)
    assert head == [run_id, batch_id, status, dport] and back.tolist() == codes
    for cut in range(len(stuffed)):
        assert dumps.batch_of(stuffed[:cut]) is None
    assert dumps.batch_of(bytes([stuffed[0] ^ 2]) + stuffed[1:]) is None


def test_one_file_in_many_ranges(spark, tmp_path):
    given_rows = batches(spark, 700)
    dumps.write_dumps(given_rows.coalesce(1), str(tmp_path / "d"))
    assert len(glob.glob(str(tmp_path / "d" / "*.txt"))) == 1
    whole = rows_of(dumps.read_dumps(spark, str(tmp_path / "d")))
    assert whole == rows_of(given_rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("997", "4099"):  # ranges end inside frames, escapes and codes
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            cut = dumps.read_dumps(spark, str(tmp_path / "d"))
            assert cut.rdd.getNumPartitions() > 5
            assert rows_of(cut) == whole
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damage(spark, tmp_path):
    path = tmp_path / "d"
    dumps.write_dumps(batches(spark, 3).coalesce(1), str(path))
    (file,) = path.glob("*.txt")
    first, second, third, rest = file.read_bytes().split(b"\x7e")
    assert rest == b""
    other = tmp_path / "other"
    other.mkdir()
    broken = bytes([second[0], second[1] ^ 1]) + second[2:]
    (other / "a").write_bytes(b"\x7e\x7e" + first + b"\x7e" + broken + b"\x7e\x7e" + third[:-1])
    (other / "empty").write_bytes(b"")
    (other / "escape").write_bytes(third[:3] + b"\x7d\x7e" + third + b"\x7e")
    kept = dumps.read_dumps(spark, str(other), on_corrupt="drop")
    assert [r[1] for r in rows_of(kept)] == [0, 2 * 0x7E7D]
    with pytest.raises(PythonException, match="cut short"):
        dumps.read_dumps(spark, str(other)).collect()
    with pytest.raises(ValueError):
        dumps.read_dumps(spark, str(other), on_corrupt="skip")


def test_no_batches_null_codes_and_codes_beyond_16_bits(spark, tmp_path):
    dumps.write_dumps(batches(spark, 0), str(tmp_path / "none"))
    assert rows_of(dumps.read_dumps(spark, str(tmp_path / "none"))) == []
    null = spark.createDataFrame([("r", 1, 2, 1, None)], RAW_BATCH)
    dumps.write_dumps(null, str(tmp_path / "null"))
    assert rows_of(dumps.read_dumps(spark, str(tmp_path / "null"))) == [("r", 1, 2, 1, ())]
    for codes in ([70000], [-1], [1, None]):
        with pytest.raises(PythonException):
            dumps.write_dumps(spark.createDataFrame([("r", 1, 2, 1, codes)], RAW_BATCH), str(tmp_path / f"bad{codes}"))


def test_intake_is_bounded(spark, tmp_path):
    """Seven files and a bound of two: four micro-batches, none with more than two files' batches."""
    for i in range(7):
        part = spark.createDataFrame([("r", 10 * i + k, 2, 1, [k]) for k in range(3)], RAW_BATCH)
        dumps.write_dumps(part.coalesce(1), str(tmp_path / "in"), mode="append")
    sizes = []

    def handle(batch, batch_id):
        kept = stored_table(batch, "intake")
        sizes.append((kept.count(), kept.select("batch_id").distinct().count()))

    stream = dumps.stream_dumps(spark, str(tmp_path / "in"), files_per_trigger=2)
    run_stream(stream, handle, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert sizes == [(6, 6), (6, 6), (6, 6), (3, 3)]
