"""Bring one value row per run back to the rows of the run."""

from pyspark.sql import functions as F

from thrustlog.plans.scan import integer_div

ROWS_PER_SLICE = 65536


def run_keys(rows):
    """What tells runs apart: a run armed more than once is one run per arming where the rows say which."""
    return [c for c in ("run_id", "arm_no") if c in rows.columns]


def join_run_values(rows, per_run, key=None, length="n", slice_rows=ROWS_PER_SLICE):
    """Join ``per_run`` to ``rows`` on run (``key``, or else ``run_keys`` of ``per_run``) and slice of the run.

    A run is cut into slices of ``slice_rows`` positions and its value row is repeated once per
    slice, so a run with a third of all rows spreads over many tasks. When the value table turns
    out small at run time, adaptive execution broadcasts it instead. Every row finds its value row;
    the left join only keeps the planner from ever broadcasting the rows.
    """
    keys = run_keys(per_run) if key is None else [key]
    sliced = per_run.withColumn(
        "_slice",
        F.explode(F.sequence(
            F.lit(0).cast("long"),
            integer_div(F.greatest(F.col(length), F.lit(1)) - 1, slice_rows),
        )),
    ).drop(length)
    return (
        rows.withColumn("_slice", integer_div(F.col("pos"), slice_rows))
        .join(sliced, [*keys, "_slice"], "left")
        .drop("_slice")
    )
