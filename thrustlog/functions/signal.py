"""From converter codes to engineering units."""

from pyspark.sql import functions as F

from thrustlog.constants import CODE_ZERO, VOLT_SPAN


def volts(code):
    return (code - F.lit(CODE_ZERO)) * F.lit(VOLT_SPAN) / F.lit(float(CODE_ZERO))


def amplifier_corrected(v, linear_adj, opamp_mul):
    return (v + linear_adj) / opamp_mul


def gained(value, scalar_adj):
    return value * scalar_adj


def calibrated_code(code, slope, intercept):
    """Device-calibrated code: half-even rounding, then clamped to 16 bits."""
    raw = F.rint(code.cast("double") * slope.cast("double") + intercept.cast("double"))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(65535.0)).cast("int")


def clip_below_zero(y):
    """Negative to zero; null stays null."""
    return F.when(y.isNotNull(), F.greatest(y, F.lit(0.0)))


def rebased_seconds(t, start, offset=0.0):
    return F.round(t - start + F.lit(float(offset)), 4)


def nan_as_null(y):
    """pandas skips NaN and finds it greater than nothing; in Spark null behaves so, NaN does not."""
    return F.when(~F.isnan(y), y)


def scan_seconds(scan_no, frequency):
    """Seconds since the start; the first scan of a run has number 1."""
    return scan_no / F.lit(frequency).cast("double")
