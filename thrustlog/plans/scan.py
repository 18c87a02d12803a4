"""Running values over one key's rows, without sorting a whole key in one task.

A plain ``Window.partitionBy(key)`` hands all rows of a key to one task, so one hot run or stand
stalls the job. Here each key is cut into ordered blocks (a stretch of time, or of batch
numbers). Rows are shuffled by (key, block); windows run inside a block; a small table with one
row per block, pre-aggregated before its shuffle, gives what enters each block from its
neighbours. The result equals the plain window for every block width.

Keys must not be null, ``order`` must be a total order, and ``block`` must never fall along it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def integer_div(column, divisor):
    return F.call_function("div", column, F.lit(divisor).cast("long"))


def time_block(ts, seconds=60):
    """Block number of a timestamp: at most one stretch of ``seconds`` in one task."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def number_block(number, width=1024):
    return F.floor(number / F.lit(width)).cast("long")


@dataclass(frozen=True)
class Running:
    """One running value: kind is ``sum``, ``total``, ``last`` or ``next``.

    ``sum`` adds up to and with the row, or before it when ``exclusive``; ``total`` is the sum over
    the key. ``last`` is the nearest non-null value at or before the row (before it when
    ``exclusive``), ``next`` the nearest one after the row.
    """

    kind: str
    value: Column
    exclusive: bool = False


def running_sum(value, exclusive=False):
    return Running("sum", value, exclusive)


def key_total(value):
    return Running("total", value)


def last_value(value):
    return Running("last", value)


def previous_value(value):
    return Running("last", value, exclusive=True)


def next_value(value):
    return Running("next", value, exclusive=True)


def _summarise(spec, value, order):
    if spec.kind in ("sum", "total"):
        return F.sum(value)
    position = F.when(value.isNotNull(), F.struct(*order))
    return F.max_by(value, position) if spec.kind == "last" else F.min_by(value, position)


def _entering(spec, value, forward, backward, whole):
    if spec.kind == "sum":
        return F.coalesce(F.sum(value).over(forward), F.lit(0))
    if spec.kind == "total":
        return F.sum(value).over(whole)
    return F.last(value, ignorenulls=True).over(forward if spec.kind == "last" else backward)


def _inside(spec, value, forward, backward):
    frame = (Window.unboundedPreceding, -1 if spec.exclusive else 0)
    if spec.kind == "sum":
        return F.coalesce(F.sum(value).over(forward.rowsBetween(*frame)), F.lit(0))
    if spec.kind == "total":
        return F.lit(0)
    return F.last(value, ignorenulls=True).over(
        (forward if spec.kind == "last" else backward).rowsBetween(*frame)
    )


def running(df, keys, order, block, **specs):
    """Add one column per spec to ``df``."""
    columns = [c for c in df.columns if c != BLOCK]
    part = [*keys, BLOCK]
    valued = df.withColumn(BLOCK, block).withColumns(
        {f"_value_{name}": spec.value for name, spec in specs.items()}
    )

    summary = valued.groupBy(*part).agg(*[
        _summarise(spec, F.col(f"_value_{name}"), order).alias(f"_sum_{name}")
        for name, spec in specs.items()
    ])
    whole = Window.partitionBy(*keys)
    before = (Window.unboundedPreceding, -1)
    entering = summary.select(*part, *[
        _entering(
            spec,
            F.col(f"_sum_{name}"),
            whole.orderBy(BLOCK).rowsBetween(*before),
            whole.orderBy(F.desc(BLOCK)).rowsBetween(*before),
            whole,
        ).alias(f"_enter_{name}")
        for name, spec in specs.items()
    ])

    inside = Window.partitionBy(*part)
    forward = inside.orderBy(*order)
    backward = inside.orderBy(*[F.desc(c) for c in order])
    placed = valued.select(*columns, BLOCK, *[
        _inside(spec, F.col(f"_value_{name}"), forward, backward).alias(f"_in_{name}")
        for name, spec in specs.items()
    ])

    # the rows lie by block already, so a merge moves the block table only; as a broadcast it would pass the driver
    joined = placed.join(entering.hint("merge"), part, "left")
    return joined.select(*columns, *[
        (
            F.col(f"_in_{name}") + F.col(f"_enter_{name}")
            if spec.kind in ("sum", "total")
            else F.coalesce(F.col(f"_in_{name}"), F.col(f"_enter_{name}"))
        ).alias(name)
        for name, spec in specs.items()
    ])


def positions(df, keys, order, block):
    """Add ``pos`` (zero-based place in the key) and ``n`` (rows of the key)."""
    one = F.lit(1).cast("long")
    return running(
        df, keys, order, block, pos=running_sum(one, exclusive=True), n=key_total(one)
    )
