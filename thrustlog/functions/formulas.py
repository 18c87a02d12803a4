"""Sensor formulas by type. ``register_formula`` adds a type; a formula maps Columns to a Column.

``inputs`` is anything that gives a Column by name: a map column or a dict of Columns.
"""

from pyspark.sql import functions as F

from thrustlog.functions.signal import amplifier_corrected, gained


def loadcell(v, inputs):
    return v


def temperature(v, inputs):
    return (v - F.lit(1.25)) / F.lit(0.005)


def pressure(v, inputs):
    return (v / F.lit(4)) * inputs["max_psi"]


FORMULAS = {"loadcell": loadcell, "temp": temperature, "pressure": pressure}

# Named inputs each formula takes; any other input in the configuration is a mistake.
FORMULA_INPUTS = {"loadcell": [], "temp": [], "pressure": ["max_psi"]}


def register_formula(sensor_type, formula, inputs=()):
    FORMULAS[sensor_type] = formula
    FORMULA_INPUTS[sensor_type] = list(inputs)


def inputs_checked(sensor_type, inputs):
    """The inputs, or a failure where they are not those the formula takes.

    Meant for the small configuration table, so that no reading pays for the check.
    """
    given = F.coalesce(F.map_keys(inputs), F.array().cast("array<string>"))
    wrong = F.lit(False)
    for name, names in FORMULA_INPUTS.items():
        expected = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        misfit = F.size(F.array_except(given, expected)) + F.size(F.array_except(expected, given))
        wrong = wrong | ((sensor_type == name) & (misfit > 0))
    return F.when(~F.coalesce(wrong, F.lit(False)), inputs).otherwise(
        F.raise_error(F.concat(F.lit("inputs do not fit the formula of "), sensor_type))
    )


def apply_formula(sensor_type, v, inputs, on_unknown="fail"):
    """Pick the formula by the value of ``sensor_type``."""
    (first, formula), *others = FORMULAS.items()
    branches = F.when(sensor_type == first, formula(v, inputs))
    for name, formula in others:
        branches = branches.when(sensor_type == name, formula(v, inputs))
    if on_unknown == "null":
        return branches.otherwise(F.lit(None).cast("double"))
    return branches.otherwise(
        F.raise_error(F.concat(F.lit("unknown sensor type "), F.coalesce(sensor_type, F.lit("null"))))
    )


def engineering_value(v, sensor_type, linear_adj, opamp_mul, scalar_adj, inputs, on_unknown="fail"):
    """Volts to engineering units: offset and amplifier, formula by type, gain."""
    corrected = amplifier_corrected(v, linear_adj, opamp_mul)
    return gained(apply_formula(sensor_type, corrected, inputs, on_unknown), scalar_adj)
