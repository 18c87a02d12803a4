"""Motor class and designation."""

from functools import reduce

from pyspark.sql import functions as F

from thrustlog.constants import MOTOR_CLASSES, UNCLASSED


def motor_class(impulse):
    """Smallest class whose bound holds the impulse.

    Nothing above the lowest bound has no class; above the highest bound the list wraps round to
    the lowest class, which ``class_overflow`` marks.
    """
    lowest, bound = MOTOR_CLASSES[0]
    ladder = reduce(
        lambda case, entry: case.when(impulse <= F.lit(entry[1]), F.lit(entry[0])),
        MOTOR_CLASSES[1:],
        F.when(impulse.isNull() | (impulse <= F.lit(bound)), F.lit(UNCLASSED)),
    )
    return ladder.otherwise(F.lit(lowest))


def class_overflow(impulse):
    return F.coalesce(impulse > F.lit(MOTOR_CLASSES[-1][1]), F.lit(False))


def designation(letter, average_thrust):
    return F.concat(letter, average_thrust.cast("long").cast("string"))
