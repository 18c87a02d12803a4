"""Trailing view of the latest points per sensor."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from thrustlog.constants import VIEW_MARGIN, VIEW_PADDING, VIEW_SECONDS, VIEW_TAIL
from thrustlog.plans.scan import BLOCK


def latest_points(rows, keys, order, block, size):
    """The latest ``size`` rows of every key with ``place`` 0 (oldest shown) to size-1 (newest).

    A count per block tells which blocks reach into the view; only their rows are ranked.
    ``history`` is the number of rows the key has in all.
    """
    part = [*keys, BLOCK]
    blocked = rows.withColumn(BLOCK, block)
    key = Window.partitionBy(*keys)
    newer = key.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    reaching = (
        blocked.groupBy(*part)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
        .withColumn("history", F.sum("_rows").over(key))
        .where(F.col("_newer") < size)
        .drop("_rows")
    )
    inside = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    rank = F.col("_newer") + F.row_number().over(inside)
    return (
        blocked.join(reaching, part)
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= size)
        .withColumn("place", (F.lit(size) - F.col("_rank")).cast("int"))
        .drop(BLOCK, "_newer", "_rank")
    )


def padded_view(latest, value, size, padding=VIEW_PADDING):
    """Fill the places left of a short history with the padding value.

    The oldest shown row of a key stands for the empty places before it as well.
    """
    place = F.col("place")
    oldest = place == F.greatest(F.lit(size) - F.col("history"), F.lit(0)).cast("int")
    filled = latest.withColumn("_own", place).withColumn(
        "place",
        F.explode(F.when(oldest, F.sequence(F.lit(0), place)).otherwise(F.array(place))),
    )
    shown = F.when(F.col("place") == F.col("_own"), F.col(value)).otherwise(F.lit(float(padding)))
    return filled.withColumn(value, shown).drop("_own", "history")


def view_size(frequency, seconds=VIEW_SECONDS):
    return seconds * frequency


def drawn_parts(view, size, margin=VIEW_MARGIN, tail=VIEW_TAIL):
    """Mark what is drawn: ``line`` for all but the newest points, ``tail`` and ``head`` at its end."""
    place = F.col("place")
    head = size - 1 - margin
    return view.where(place <= head).withColumns({
        "line": F.lit(True),
        "tail": place >= F.lit(size - tail),
        "head": place == head,
    })
