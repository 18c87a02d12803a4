"""Burn analysis against a plain reading of its definition, edge runs included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thrustlog.operators import analysis as A

RATE = 10


def low(values):
    values = [v for v in values if v is not None]
    return min(values) if values else None


def high(values):
    values = [v for v in values if v is not None]
    return max(values) if values else None


def burn(samples, f):
    """Start and end time of ``[(t, y)]``."""
    n, ys = len(samples), [y for _, y in samples]
    floor, top = low(ys[f:2 * f]), high(ys[f:max(n - f, 0)])
    tail = low(ys[max(n - 2 * f, 0):max(n - f, 0)])

    def above(y, base, part):
        return None not in (y, base, top) and y > (top - base) * part + base

    starts = [t for t, y in samples if above(y, floor, 0.10)]
    start = starts[0] if starts else samples[0][0]
    ends = [t for t, y in samples if t > start + 0.01 and above(y, tail, 0.05)]
    return floor, start, ends[-1] if ends else samples[-1][0]


def summary(samples, f):
    floor, start, end = burn(samples, f)
    cut = [
        (round(t - start, 4), None if None in (y, floor) else y - floor)
        for t, y in samples if start < t < end
    ]
    if not cut:
        return None
    _, again, finish = burn(cut, f)
    ys = [None if y is None else max(y, 0.0) for _, y in cut]
    known = [y for y in ys if y is not None]
    impulse = None
    if len(known) == len(ys):
        impulse = sum((a + b) / 2 / f for a, b in zip(ys, ys[1:]))
    return impulse, sum(known) / len(known) if known else None, again, finish


def runs():
    rng = random.Random(5)

    def noise():
        return rng.uniform(-0.2, 0.2)

    def motor(idle, burning, rest):
        level = [0.0] * idle + [rng.uniform(20, 40) for _ in range(burning)] + [0.0] * rest
        return [v + noise() for v in level]

    made = {
        "shorter-than-f": [1.0, 5.0, 2.0],
        "between-f-and-2f": motor(6, 5, 4),
        "short-burn": motor(30, 12, 30),
        "long-burn": motor(30, 55, 30),
        "flat": [1.5] * 60,
        "spike-in-first-second": [90.0] + motor(29, 20, 30),
        "missing": [None if i % 9 == 0 else v for i, v in enumerate(motor(30, 40, 30))],
        "negative": [v - 15 for v in motor(25, 30, 25)],
    }
    for i in range(25):
        made[f"random-{i}"] = [rng.uniform(-5, 30) for _ in range(rng.randint(1, 90))]
    return made


@pytest.fixture(scope="module")
def trace(spark):
    rows = [
        (name, pos, len(ys), (pos + 1) / RATE, float("nan") if y is None else y)
        for name, ys in runs().items() for pos, y in enumerate(ys)
    ]
    df = spark.createDataFrame(rows, "run_id string, pos long, n long, t double, y double")
    return df.withColumn("y", A.nan_as_null(F.col("y")))


def close(a, b):
    return a == b if None in (a, b) else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_summary_equals_definition(trace):
    got = {r.run_id: r for r in A.run_summary(trace, RATE).collect()}
    assert set(got) == set(runs())
    for name, ys in runs().items():
        samples = [((i + 1) / RATE, y) for i, y in enumerate(ys)]
        row, want = got[name], summary(samples, RATE)
        _, start, end = burn(samples, RATE)
        assert close(row.burn_time_first_pass, end - start), name
        if want is None:
            assert row.impulse is None and row.designation is None and row.burn_time is None
            continue
        impulse, thrust, again, finish = want
        assert close(row.average_thrust, thrust), name
        if thrust is not None:
            assert close(row.impulse, impulse), name
        assert close(row.start_time, again) and close(row.end_time, finish), name


def test_steps_agree_with_summary(trace):
    cut = A.cut_trace(trace, RATE)
    parts = A.impulse_and_thrust(cut, RATE).join(A.burn_time(cut, RATE), "run_id")
    whole = {r.run_id: r for r in A.run_summary(trace, RATE).collect()}
    for r in parts.collect():
        w = whole[r.run_id]
        assert close(r.average_thrust, w.average_thrust) and close(r.burn_time, w.burn_time)
        if w.average_thrust is not None:
            assert close(r.impulse, w.impulse)


def test_runs_of_two_rates_in_one_table(trace):
    slow = trace.select(F.concat(F.lit("slow-"), "run_id").alias("run_id"), "pos", "n", (F.col("t") * 2).alias("t"), "y")
    mixed = trace.withColumn("rate", F.lit(RATE)).unionByName(slow.withColumn("rate", F.lit(RATE // 2)))
    rate = F.col("rate")
    want = A.run_summary(trace, RATE).unionByName(A.run_summary(slow, RATE // 2)).collect()
    assert sorted(A.run_summary(mixed, rate).collect(), key=str) == sorted(want, key=str)
    cut, parts = A.cut_trace(mixed, rate), A.cut_trace(slow, RATE // 2)
    found = A.cumulative_impulse(cut, rate).where("run_id like 'slow-%'").collect()
    assert sorted(found, key=str) == sorted(A.cumulative_impulse(parts, RATE // 2).collect(), key=str)


def test_slices_do_not_change_results(spark, trace):
    from thrustlog.plans.per_run import join_run_values

    limits = A.run_limits(trace, RATE).withColumnRenamed("n", "_length")
    one = join_run_values(trace, limits, length="_length")
    many = join_run_values(trace, limits, length="_length", slice_rows=7)
    assert one.exceptAll(many).count() == 0 and one.count() == trace.count() == many.count()


def test_cumulative_impulse_ends_at_impulse(trace):
    cut = A.cut_trace(trace, RATE).where("run_id = 'long-burn'")
    last = A.cumulative_impulse(cut, RATE, block_rows=8).orderBy(F.desc("pos")).first()
    assert close(last.impulse, A.impulse_and_thrust(cut, RATE).first().impulse)


def test_each_arming_has_its_own_summary(spark):
    """A run armed twice gives the summaries of two runs that are armed once."""
    from thrustlog.operators.convert import wide_scans
    from thrustlog.operators.decode import accepted_batches
    from thrustlog.registry.views import sensors
    from thrustlog.schemas import RAW_BATCH
    from thrustlog.session import stored_table

    def batch(run, number, code, dport=1):
        return (run, number, 2, dport, [code, 0, 0, 0, 0] * RATE)

    first, second = [900, 900, 900, 1900, 1800, 900, 900, 900], [1000, 1000, 1700, 1600, 1500, 1400, 1000, 1000, 1000]
    twice = [batch("twice", i, c) for i, c in enumerate(first)] + [("twice", 8, 2, 0, []), ("twice", 9, 2, 0, [])]
    twice += [batch("twice", 10 + i, c) for i, c in enumerate(second)]
    single = [batch("one", i, c) for i, c in enumerate(first)] + [batch("two", i, c) for i, c in enumerate(second)]
    raw = spark.createDataFrame(twice + single, RAW_BATCH)
    wide = wide_scans(accepted_batches(raw, 5, RATE), sensors(spark).collect(), RATE, only=["Load Cell"])
    trace = stored_table(A.trace_from_wide(wide), "gated-trace")
    got = {(r.run_id, r.arm_no): r[2:] for r in A.run_summary(trace, RATE, stored_table).collect()}
    assert set(got) == {("twice", 1), ("twice", 2), ("one", 1), ("two", 1)}
    assert got["twice", 1] == got["one", 1] and got["twice", 2] == got["two", 1] and None not in got["twice", 1]
    assert got["twice", 1] != got["twice", 2]
    assert {"arm_no", "run_scans"} <= set(wide.columns) and trace.count() == trace.select("run_id", "arm_no", "pos").distinct().count()


def test_armings_stay_apart_in_logs(spark, tmp_path):
    from thrustlog.sources import logs

    names = ["Load Cell"]
    rows = [("a b", arm, s / RATE, float(s * arm)) for arm in (1, 2) for s in range(3)]
    wide = spark.createDataFrame(rows, "run_id string, arm_no long, seconds double, `Load Cell` double")
    folder = str(tmp_path / "log")
    logs.append_log(wide, folder)
    back = logs.read_log(spark, folder, names, file_name="*.csv", armed=True)
    assert sorted(back.select(wide.columns).collect()) == sorted(wide.collect())
    assert {r.run_id for r in logs.read_log(spark, folder, names, file_name="*.csv").collect()} == {"a b"}
    part = logs.read_partitioned_log(spark, folder, names)
    assert sorted(map(tuple, part.select(wide.columns).collect())) == sorted(rows)
    trace = A.trace_from_log(back)
    assert sorted((r.arm_no, r.pos, r.n) for r in trace.collect()) == [(a, p, 3) for a in (1, 2) for p in range(3)]
