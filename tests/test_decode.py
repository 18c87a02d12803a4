"""Batches on hand-made cases; micro-batches against the whole."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thrustlog.operators import calibrate, convert, decode, gates, view
from thrustlog.plans.scan import number_block
from thrustlog.schemas import RAW_BATCH
from thrustlog.streaming.ingest import RUN_STATE, accept_more, state_after

EXAMPLE = [
    ("a", 1, 2, 1, [1, 2, 3, 4, 5]),
    ("a", 2, 2, 1, []),
    ("a", 3, 2, 0, [6, 7, 8]),
    ("a", 4, 2, 0, [9, 9]),
    ("b", 1, 6, 1, [1, 2]),
    ("b", 2, 2, 1, [1, 2]),
]


def ids(df):
    return sorted((r.run_id, r.batch_id) for r in df.collect())


def test_gates(spark):
    raw = spark.createDataFrame(EXAMPLE, RAW_BATCH)
    assert ids(decode.running_batches(raw)) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2)]
    assert ids(decode.while_armed(decode.arm_batches(raw))) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert ids(decode.until_overrun(decode.gate_batches(raw))) == [("a", 1), ("a", 2), ("a", 3)]


def test_each_arming_has_its_own_time_axis(spark):
    ports = [1, 1, 0, 0, 1, 1]
    rows = [("a", i, 2, port, [0] * 4) for i, port in enumerate(ports)]
    rows += [("b", 0, 6, 0, [0] * 4), ("b", 1, 2, 1, [0] * 4), ("b", 2, 6, 1, [0] * 4), ("b", 3, 2, 0, [0] * 4), ("b", 4, 2, 1, [0] * 4)]
    got = decode.accepted_batches(spark.createDataFrame(rows, RAW_BATCH), 2, 10).collect()
    assert sorted((r.run_id, r.arm_no, r.batch_id, r.scan_offset) for r in got) == [
        ("a", 1, 0, 0), ("a", 1, 1, 2), ("a", 1, 2, 4), ("a", 2, 4, 0), ("a", 2, 5, 2), ("b", 1, 1, 0), ("b", 2, 4, 0),
    ]


def test_readings_number_scans_over_batches(spark):
    raw = spark.createDataFrame(EXAMPLE, RAW_BATCH).where("run_id = 'a'")
    got = decode.readings(decode.accepted_batches(raw, 2, 10), 2, 10).orderBy("scan_no", "channel")
    assert [(r.scan_no, r.channel, r.code, r.seconds) for r in got.collect()] == [
        (1, 0, 1, 0.1), (1, 1, 2, 0.1), (2, 0, 3, 0.2), (2, 1, 4, 0.2), (3, 0, 6, 0.3), (3, 1, 7, 0.3),
    ]


def test_run_time_keeps_the_crossing_batch(spark):
    rows = [("a", i, 2, 1, [0] * 10) for i in range(5)]
    numbered = decode.number_batches(spark.createDataFrame(rows, RAW_BATCH), 1)
    assert ids(decode.until_run_time(numbered, 10, 1.5)) == [("a", 0), ("a", 1)]
    assert ids(decode.until_run_time(numbered, 10, 1.0)) == [("a", 0), ("a", 1)]
    assert decode.until_run_time(numbered, 10, 0).count() == 5


def logger(rows, nchan):
    """The logger's loop over one run's batches in turn."""
    found, armed, arm_no = [], False, 0
    overrun, transfers, scans = False, 0, 0
    for run, number, status, port, data in sorted(rows, key=lambda r: r[1]):
        if port and not armed:
            arm_no, overrun, transfers, scans = arm_no + 1, False, 0, 0
        if port or armed:
            overrun |= bool(status & 4)
            if not overrun and status == 2 and data:
                transfers += 1
                found.append((run, arm_no, number, transfers, scans))
                scans += len(data) // nchan
        armed = bool(port)
    length = {}
    for (_, arm, *_), data in zip(found, (next(r[4] for r in rows if r[1] == f[2]) for f in found), strict=True):
        length[arm] = length.get(arm, 0) + len(data) // nchan
    return [(*f, length[f[1]]) for f in found]


@pytest.mark.parametrize("block_width", [1, 2, 7, 256])
@pytest.mark.parametrize("overruns", [1, 8])
def test_gates_equal_the_loop_for_every_block_width(spark, block_width, overruns):
    rng = random.Random(block_width * overruns)
    rows = [
        (run, 3 * i - 40, rng.choices([2, 6, 0], [40, overruns, 4])[0], int(rng.random() < share), [0] * rng.randint(0, 13))
        for run, share in (("often", 0.9), ("half", 0.5), ("rarely", 0.1), ("always", 1.0), ("never", 0.0)) for i in range(90)
    ]
    placed = gates.in_blocks(spark.createDataFrame(rows, RAW_BATCH), 3, block_width)
    got = gates.accepted(placed, gates.composed(gates.pieces(placed))).collect()
    expected = [x for run in ("often", "half", "rarely", "always", "never") for x in logger([r for r in rows if r[0] == run], 3)]
    assert sorted((r.run_id, r.arm_no, r.batch_id, r.transfer_no, r.scan_offset, r.run_scans) for r in got) == sorted(expected)


def test_gates_move_the_rows_once(spark, tmp_path):
    spark.createDataFrame([("a", i, 2, 1, [0] * 4) for i in range(4)], RAW_BATCH).write.parquet(str(tmp_path / "raw"))
    plan = decode.accepted_batches(spark.read.parquet(str(tmp_path / "raw")), 2, 10)._jdf.queryExecution().sparkPlan().toString()
    executed = decode.accepted_batches(spark.read.parquet(str(tmp_path / "raw")), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and executed.count("Exchange hashpartitioning") <= 4


def test_null_ports_and_status_count_as_zero(spark):
    rows = [("a", 0, 2, None, [1, 2]), ("a", 1, 2, 1, [1, 2]), ("a", 2, None, 1, [1, 2]), ("a", 3, 2, None, [1, 2]), ("a", 4, 2, 0, [1, 2]), ("a", 5, 2, 1, None)]
    got = decode.accepted_batches(spark.createDataFrame(rows, RAW_BATCH), 2, 10).collect()
    assert sorted((r.batch_id, r.transfer_no) for r in got) == [(1, 1), (3, 2)]


def test_micro_batches_equal_whole(spark):
    rng = random.Random(4)
    rows = [
        ("hot" if rng.random() < 0.5 else rng.choice("abc"), i,
         rng.choices([2, 6, 0], [40, 1, 4])[0], int(rng.random() < 0.7),
         [rng.randint(0, 4095) for _ in range(rng.randint(0, 13))])
        for i in range(200)
    ]
    whole = decode.accepted_batches(spark.createDataFrame(rows, RAW_BATCH), 3, 5, 6)
    state, seen = spark.createDataFrame([], RUN_STATE), []
    for part in range(4):
        batch = spark.createDataFrame(rows[part * 50:(part + 1) * 50], RAW_BATCH)
        accepted = accept_more(batch, state, 3, 5, 6)
        seen += [(r.run_id, r.arm_no, r.batch_id, r.transfer_no, r.scan_offset) for r in accepted.collect()]
        state = spark.createDataFrame(state_after(batch, state, 3).collect(), RUN_STATE)
    assert sorted(seen) == sorted(
        (r.run_id, r.arm_no, r.batch_id, r.transfer_no, r.scan_offset) for r in whole.collect()
    )


def test_idle_runs_leave_the_stream_state(spark):
    now = datetime(2024, 1, 8)
    before = spark.createDataFrame(
        [("old", 1, 1, 0, 1, 1, datetime(2024, 1, 1)), ("new", 1, 1, 0, 1, 1, datetime(2024, 1, 7))], RUN_STATE
    )
    batch = spark.createDataFrame([("now", 0, 2, 1, [1, 2])], RAW_BATCH)
    state = state_after(batch, before, 2, now, retention_sec=2 * 86_400)
    assert sorted(r.run_id for r in state.collect()) == ["new", "now"]


def test_equal_load_leaves_gain_null(spark):
    volts = spark.createDataFrame(
        [("s", 0, p, 30, 1.0) for p in range(30)], "stand_id string, channel int, pos long, n long, volts double"
    )
    refs = spark.createDataFrame([("s", 70.0, 10.0)], "stand_id string, ambient_f double, load_lbs double")
    row = calibrate.calibrate_loadcell(volts, volts, refs, 10).first()
    assert row.scalar_adj is None and row.linear_adj == -1.0 and row.max == 70.0


def test_sensor_names_follow_channels(spark):
    config = spark.createDataFrame([(1, "b"), (0, "z"), (2, "a")], "channel int, sensor_name string")
    assert convert.sensor_names(config).first().sensor_names == ["z", "b", "a"]


def test_view_pads_and_marks(spark):
    rows = spark.createDataFrame([("s", i, float(i)) for i in range(4)] + [("t", i, float(i)) for i in range(30)],
                                 "k string, i long, y double")
    latest = view.latest_points(rows, ["k"], ["i"], number_block(F.col("i"), 7), 12)
    shown = view.padded_view(latest, "y", 12)
    got = {k: [r.y for r in shown.where(F.col("k") == k).orderBy("place").collect()] for k in "st"}
    assert got == {"s": [50.0] * 8 + [0.0, 1.0, 2.0, 3.0], "t": [float(i) for i in range(18, 30)]}
    drawn = view.drawn_parts(shown, 12).where("k = 's'").orderBy("place").collect()
    assert [r.place for r in drawn] == list(range(10))
    assert [r.place for r in drawn if r.tail] == list(range(2, 10))
    assert [r.place for r in drawn if r.head] == [9]


def test_no_row_is_lost_without_an_entry(spark):
    from thrustlog.plans.lookup import lookup_join

    rows = spark.range(9).select((F.col("id") % 3).alias("k"), "id")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    assert lookup_join(rows, table, ["k"], "drop").count() == 6
    assert lookup_join(rows, table, ["k"], "null").where("name IS NULL").count() == 3
    assert lookup_join(rows.where("k < 2"), table, ["k"]).count() == 6
    with pytest.raises(Exception, match="no entry for k: 2"):
        lookup_join(rows, table, ["k"]).collect()
