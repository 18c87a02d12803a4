"""Analysis of a thrust trace per run.

A trace has the columns ``run_id, pos, n, t, y``: zero-based position in the run, rows in the run,
seconds, thrust; ``arm_no`` too where a run is cut into armings, each of which is then a run of its
own. Their ``f``, samples a second, is a number or a column of the trace: runs of different rates carry
``rate`` from batches to summary and are analysed together. All detectors are aggregates by run, combined before the shuffle; what they find
comes back to the rows by ``join_run_values``, which spreads a long run over many tasks.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from thrustlog.constants import (
    DEFAULT_THRUST_SENSOR,
    END_FRACTION,
    END_SEARCH_DELAY_SEC,
    REPORT_MARGIN_SEC,
    START_FRACTION,
)
from thrustlog.functions.motor import class_overflow, designation, motor_class
from thrustlog.functions.rounding import fixed, rounddown, roundup
from thrustlog.functions.signal import clip_below_zero, nan_as_null, rebased_seconds
from thrustlog.plans.per_run import join_run_values, run_keys
from thrustlog.plans.scan import number_block, positions, previous_value, running, running_sum


def run_rate(rows):
    """The column with each run's rate, where the rows have it."""
    return [c for c in ("rate",) if c in rows.columns]


def per_second(f):
    return f.cast("double") if isinstance(f, Column) else F.lit(float(f))


def trace_from_readings(converted, thrust_sensor=DEFAULT_THRUST_SENSOR):
    """Thrust trace of gap-free runs: positions follow from the scan numbers, no sort needed.

    With ``run_scans`` in the readings the trace is a plain filter and projection; without it the
    scans of each run are counted first.
    """
    thrust = converted.where(F.col("sensor_name") == thrust_sensor)
    y = nan_as_null(F.col("value")).alias("y")
    if "run_scans" in converted.columns:
        return thrust.select(
            *run_keys(thrust),
            (F.col("scan_no") - 1).alias("pos"),
            F.col("run_scans").alias("n"),
            F.col("seconds").alias("t"),
            y,
            *run_rate(thrust),
        )
    runs = thrust.groupBy(*run_keys(thrust)).agg(
        F.min("scan_no").alias("_first"),
        F.count("*").alias("n"),
        (F.max("scan_no") + 1).alias("_reach"),
    )
    placed = thrust.select(*run_keys(thrust), F.col("scan_no").alias("pos"), "seconds", "value", *run_rate(thrust))
    joined = join_run_values(placed, runs, length="_reach")
    return joined.select(
        *run_keys(thrust), (F.col("pos") - F.col("_first")).alias("pos"), "n", F.col("seconds").alias("t"), y, *run_rate(thrust)
    )


def trace_from_wide(wide, thrust_sensor=DEFAULT_THRUST_SENSOR):
    """Thrust trace of wide readings that carry ``run_scans``."""
    return wide.select(
        *run_keys(wide),
        (F.col("scan_no") - 1).alias("pos"),
        F.col("run_scans").alias("n"),
        F.col("seconds").alias("t"),
        nan_as_null(F.col(thrust_sensor)).alias("y"),
        *run_rate(wide),
    )


def placed_log(log, block_seconds=600):
    """Wide log of any runs with ``pos`` and ``n``, counted by time within blocks of a run."""
    block = F.floor(F.col("seconds") / F.lit(block_seconds))
    return positions(log, run_keys(log), ["seconds"], block)


def trace_from_log(log, thrust_sensor=DEFAULT_THRUST_SENSOR, block_seconds=600):
    """Thrust trace of a stored wide log: ``run_id``, ``seconds`` and a column per sensor."""
    keys = run_keys(log)
    return placed_log(log.select(*keys, "seconds", thrust_sensor), block_seconds).select(
        *keys, "pos", "n", F.col("seconds").alias("t"), nan_as_null(F.col(thrust_sensor)).alias("y")
    )


def trace_with_gaps(rows, order, block):
    """Trace of runs whose positions must be counted: ``run_id, t, y`` plus the order columns."""
    keys = run_keys(rows)
    placed = positions(rows, keys, order, block)
    return placed.select(*keys, "pos", "n", "t", nan_as_null(F.col("y")).alias("y"))


def second_one(pos, f):
    """Second second of a run: the first one may be dirty."""
    return (pos >= f) & (pos < 2 * f)


def interior(pos, n, f):
    return (pos >= f) & (pos < n - f)


def last_but_one_second(pos, n, f):
    return (pos >= F.greatest(n - 2 * f, F.lit(0))) & (pos < n - f)


def _limits(pos, n, y, f):
    """Aggregates for the limits of a trace."""
    return [
        F.min(F.when(second_one(pos, f), y)).alias("starting_min"),
        F.max(F.when(interior(pos, n, f), y)).alias("test_max"),
        F.min(F.when(last_but_one_second(pos, n, f), y)).alias("ending_min"),
    ]


def _threshold(test_max, floor, fraction):
    return (test_max - floor) * F.lit(fraction) + floor


def _ends(pos, t, y, limits):
    """Aggregates for the outermost rows of a trace and those above the thresholds."""
    starts = y > _threshold(limits["test_max"], limits["starting_min"], START_FRACTION)
    lasts = y > _threshold(limits["test_max"], limits["ending_min"], END_FRACTION)
    return [
        F.min(t).alias("_first"),
        F.max(t).alias("_last"),
        F.min(F.when(starts, t)).alias("_above_first"),
        F.max(F.when(lasts, t)).alias("_above_last"),
        F.min(pos).alias("_first_pos"),
        F.max(pos).alias("_last_pos"),
        F.min(F.when(starts, pos)).alias("_above_first_pos"),
        F.max(F.when(lasts, pos)).alias("_above_last_pos"),
    ]


def _burn(names=("start_t", "end_t", "start_pos", "end_pos")):
    """Start and end from those aggregates.

    The end is the last row above its threshold if that lies beyond the start by the delay; every
    earlier such row lies nearer to the start, so one pass finds both.
    """
    start = F.coalesce(F.col("_above_first"), F.col("_first"))
    late = F.col("_above_last") > start + F.lit(END_SEARCH_DELAY_SEC)
    return [
        start.alias(names[0]),
        F.when(late, F.col("_above_last")).otherwise(F.col("_last")).alias(names[1]),
        F.coalesce(F.col("_above_first_pos"), F.col("_first_pos")).alias(names[2]),
        F.when(late, F.col("_above_last_pos")).otherwise(F.col("_last_pos")).alias(names[3]),
    ]


def _kept_values(names):
    return [F.any_value(name).alias(name) for name in names]


def run_limits(trace, f):
    """Per run: rows, ``starting_min``, ``test_max`` and ``ending_min``."""
    return trace.groupBy(*run_keys(trace)).agg(
        F.max("n").alias("n"), *_limits(F.col("pos"), F.col("n"), F.col("y"), f)
    )


LIMITS = ["starting_min", "test_max", "ending_min"]
BURN = ["start_t", "end_t", "start_pos", "end_pos"]


def not_kept(table, purpose):
    return table


def detect_burn(trace, f, keep=not_kept):
    """Per run: limits and the burn's start and end.

    ``keep(table, purpose)`` may store the values per run between the passes, for example with
    ``session.stored_table``. Spark then knows their true size when it plans the next pass: it
    broadcasts a small table and leaves the trace unshuffled, and joins by slices otherwise.
    """
    limits = keep(run_limits(trace, f), "run-limits").withColumnRenamed("n", "_length")
    limited = join_run_values(trace, limits, length="_length")
    keys = run_keys(trace)
    found = limited.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *_kept_values(LIMITS),
        *_ends(F.col("pos"), F.col("t"), F.col("y"), {c: F.col(c) for c in LIMITS}),
    )
    return found.select(*keys, "n", *LIMITS, *_burn())


def zero_thrust(trace, f):
    """Thrust less the minimum of the run's second second."""
    limits = run_limits(trace, f).select(*run_keys(trace), F.col("n").alias("_length"), "starting_min")
    return (
        join_run_values(trace, limits, length="_length")
        .withColumn("y", F.col("y") - F.col("starting_min"))
        .drop("starting_min")
    )


def _cut(trace, burn, margin):
    """Rows of ``trace`` inside the burn, with all columns of ``burn``."""
    t, margin = F.col("t"), F.lit(float(margin))
    bounds = burn.withColumnRenamed("n", "_length")
    return join_run_values(trace, bounds, length="_length").where(
        (t > F.col("start_t") - margin) & (t < F.col("end_t") + margin)
    )


def _inner():
    """Position, length, time and thrust of a row when only the burn itself is kept."""
    return (
        F.col("pos") - F.col("start_pos") - 1,
        F.col("end_pos") - F.col("start_pos") - 1,
        rebased_seconds(F.col("t"), F.col("start_t")),
        F.col("y") - F.col("starting_min"),
    )


def cut_trace(trace, f, margin=0.0, burn=None):
    """Rows inside the burn (both ends left out), thrust zeroed, time from the burn's start.

    Positions and length are those of the kept rows, so the detectors work on the result. ``burn``
    may be given when it is already known. Times rise with positions, so the kept rows are one
    stretch; without a margin the burn's own ends bound it.
    """
    burn = detect_burn(trace, f) if burn is None else burn
    kept = _cut(trace, burn, margin)
    pos, rows, _, zeroed = _inner()
    if margin:
        stretch = kept.groupBy(*run_keys(kept)).agg(
            F.min("pos").alias("_from"),
            F.max("pos").alias("_to"),
            F.max("n").alias("_length"),
        )
        kept = join_run_values(kept, stretch, length="_length")
        pos, rows = F.col("pos") - F.col("_from"), F.col("_to") - F.col("_from") + 1
    return kept.select(
        *run_keys(kept),
        pos.alias("pos"),
        rows.alias("n"),
        rebased_seconds(F.col("t"), F.col("start_t"), margin).alias("t"),
        zeroed.alias("y"),
        *run_rate(kept),
    )


def _figures(pos, y, present, f):
    """Aggregates for kept rows, impulse and average thrust; ``present`` marks the kept rows.

    Impulse is the trapezoid rule at step 1/f over thrust above zero. Its closed form needs only
    sums and the two end values, so no row order. A missing thrust value makes it unknown.
    """
    clipped = clip_below_zero(y)
    area = F.sum(clipped) - (F.min_by(clipped, pos) + F.max_by(clipped, pos)) / F.lit(2.0)
    whole = F.count(clipped) == F.count_if(present)
    rate = F.max(per_second(f)) if isinstance(f, Column) else per_second(f)
    return [
        F.count_if(present).alias("kept"),
        F.when(whole, area / rate).alias("impulse"),
        F.avg(clipped).alias("average_thrust"),
    ]


def impulse_and_thrust(cut, f):
    """Per run of a cut trace: kept rows, impulse and average thrust."""
    return cut.groupBy(*run_keys(cut)).agg(*_figures(F.col("pos"), F.col("y"), F.lit(True), f))


def cumulative_impulse(cut, f, block_rows=4096):
    """Impulse up to each row, by pairs of neighbours."""
    block = number_block(F.col("pos"), block_rows)
    y = clip_below_zero(F.col("y"))
    # sum of pair areas up to a row = step * (sum so far - half the first - half the own value)
    summed = running(
        cut.withColumn("_y", y),
        run_keys(cut),
        ["pos"],
        block,
        _sum=running_sum(F.col("_y")),
        _first=previous_value(F.when(F.col("pos") == 0, F.col("_y"))),
    )
    first = F.coalesce(F.col("_first"), F.col("_y"))
    area = (F.col("_sum") - (first + F.col("_y")) / F.lit(2.0)) / per_second(f)
    return summed.select(*run_keys(cut), "pos", "t", area.alias("impulse"))


def burn_time(cut, f):
    """Per run: burn found again on the cut trace, as the logger's report does."""
    again = detect_burn(cut, f)
    return again.select(
        *run_keys(cut),
        F.col("start_t").alias("start_time"),
        F.col("end_t").alias("end_time"),
        (F.col("end_t") - F.col("start_t")).alias("burn_time"),
    )


def run_summary(trace, f, keep=not_kept):
    """One row per run (and arming, where the trace has ``arm_no``): class, designation, impulse, average thrust, burn time, start, end.

    Four aggregates over the trace, each with the values of the one before joined to its rows:
    limits, burn, figures and limits of the cut rows, burn of the cut rows. A run that keeps no
    row, or is too short to be zeroed, has nulls in place of its figures. ``keep`` as in
    ``detect_burn``.
    """
    keys = run_keys(trace)
    burn = keep(detect_burn(trace, f, keep), "run-burns")
    inside = (F.col("t") > F.col("start_t")) & (F.col("t") < F.col("end_t"))

    def kept(column):
        return F.when(inside, column)

    def bounded(values):
        return join_run_values(trace, values.withColumnRenamed("n", "_length"), length="_length")

    inner_pos, rows, inner_t, zeroed = _inner()
    pos, t, y = kept(inner_pos), kept(inner_t), kept(zeroed)
    carried = ["start_t", "end_t", "start_pos", "end_pos", "starting_min"]
    cut_limits = [c.alias(f"cut_{n}") for n, c in zip(LIMITS, _limits(pos, rows, y, f))]
    figures = ["impulse", "average_thrust", *[f"cut_{name}" for name in LIMITS]]
    measured = bounded(burn).groupBy(*keys).agg(
        F.max("n").alias("n"),
        *_kept_values(carried),
        *_figures(pos, y, inside, f),
        *cut_limits,
    )
    again = bounded(keep(measured, "run-figures")).groupBy(*keys).agg(
        *_kept_values(["start_t", "end_t", *figures]),
        *_ends(pos, t, y, {name: F.col(f"cut_{name}") for name in LIMITS}),
    )
    found = again.select(
        *keys,
        "impulse",
        "average_thrust",
        (F.col("end_t") - F.col("start_t")).alias("burn_time_first_pass"),
        *_burn(("start_time", "end_time", "_from", "_to")),
    )
    impulse, thrust = F.col("impulse"), F.col("average_thrust")
    known = thrust.isNotNull()
    return found.select(
        *keys,
        F.when(known, motor_class(impulse)).alias("motor_class"),
        F.when(known, designation(motor_class(impulse), thrust)).alias("designation"),
        F.when(known, impulse).alias("impulse"),
        thrust,
        (F.col("end_time") - F.col("start_time")).alias("burn_time"),
        "start_time",
        "end_time",
        "burn_time_first_pass",
        class_overflow(impulse).alias("class_overflow"),
    )


def summary_text(summary):
    """The report of each run as text, in the logger's layout."""
    lines = [
        F.concat(F.lit("Motor: "), F.col("designation")),
        F.concat(F.lit("Impulse: "), fixed(F.col("impulse"), 2), F.lit(" Ns")),
        F.concat(F.lit("Average Thrust: "), fixed(F.col("average_thrust"), 2), F.lit(" N")),
        F.concat(F.lit("Burn Time: "), fixed(F.col("burn_time"), 1), F.lit(" s")),
        F.concat(F.lit("Start Time: "), fixed(F.col("start_time"), 1), F.lit(" s")),
        F.concat(F.lit("End Time: "), fixed(F.col("end_time"), 1), F.lit(" s")),
    ]
    indent = F.lit("\n" + 8 * " ")
    text = F.concat(*[part for line in lines for part in (indent, line, F.lit("  "))], indent)
    return summary.select(*run_keys(summary), text.alias("value"))


def margin_log(placed, burn, margin=REPORT_MARGIN_SEC, thrust_sensor=DEFAULT_THRUST_SENSOR):
    """Wide rows around the burn, thrust zeroed, time from the margin's start: the processed trace.

    ``placed`` has ``run_id``, ``pos``, ``seconds`` and a column per sensor.
    """
    keys = run_keys(placed)
    bounds = burn.select(*keys, "starting_min", "start_t", "end_t", F.col("n").alias("_length"))
    seconds, lit = F.col("seconds"), F.lit(float(margin))
    kept = join_run_values(placed, bounds, length="_length").where(
        (seconds > F.col("start_t") - lit) & (seconds < F.col("end_t") + lit)
    )
    sensors = [c for c in placed.columns if c not in ("run_id", "arm_no", "pos", "n", "seconds", "scan_no", "run_scans", "rate")]
    return kept.select(
        *keys,
        rebased_seconds(seconds, F.col("start_t"), margin).alias("seconds"),
        *[(F.col(c) - F.col("starting_min") if c == thrust_sensor else F.col(c)).alias(c) for c in sensors],
    )


def report_extremes(processed, sensor_names):
    """Least and largest value per run and sensor of a processed trace, one aggregate over its wide rows."""
    names = [c for n in sensor_names for c in (F.min(n).alias(f"low {n}"), F.max(n).alias(f"high {n}"))]
    keys = run_keys(processed)
    per_run = processed.groupBy(*keys).agg(*names)
    rows = [F.struct(F.lit(n).alias("sensor_name"), F.col(f"low {n}").alias("_low"), F.col(f"high {n}").alias("_high")) for n in sensor_names]
    return per_run.select(*keys, F.explode(F.array(*rows)).alias("_row")).select(*keys, "_row.*")


def report_axis(extremes, config, thrust_sensor=DEFAULT_THRUST_SENSOR, step=10):
    """Per run and sensor: axis limits of the report, from ``report_extremes``; a sensor without a configuration has its data's."""
    limits = config.select(
        "sensor_name", F.col("min").alias("_config_low"), F.col("max").alias("_config_high")
    )
    low = F.when(F.col("sensor_name") == thrust_sensor, F.lit(-1.0)).otherwise(
        F.coalesce(rounddown(F.col("_low"), step), F.col("_config_low"))
    )
    high = F.coalesce(roundup(F.col("_high"), step), F.col("_config_high"))
    return (
        extremes.join(limits, "sensor_name", "left")
        .select(*run_keys(extremes), "sensor_name", low.alias("axis_min"), high.alias("_top"))
        .withColumn(
            "axis_max",
            F.when(F.col("axis_min") == F.col("_top"), F.col("_top") + F.lit(10.0)).otherwise(
                F.col("_top")
            ),
        )
        .drop("_top")
    )
