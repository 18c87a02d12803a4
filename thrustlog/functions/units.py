"""Unit conversions used in calibration."""

from pyspark.sql import functions as F

from thrustlog.constants import NEWTONS_PER_POUND


def celsius(fahrenheit):
    return (fahrenheit - F.lit(32)) * F.lit(5 / 9)


def newtons(pounds):
    return pounds * F.lit(NEWTONS_PER_POUND)


def expected_temperature_volts(degrees_c, opamp_mul):
    return (degrees_c * F.lit(0.005) + F.lit(1.25)) * opamp_mul
