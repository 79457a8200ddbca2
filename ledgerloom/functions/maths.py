"""The fourteen mathematical functions."""

from __future__ import annotations

from pyspark.sql import functions as F

FUNCTIONS = {
    "pi": lambda: F.pi(),
    "pow": lambda x, y: F.pow(x, y),
    "exp": lambda x: F.exp(x),
    "exp10": lambda x: F.pow(F.lit(10.0), x),
    "log": lambda x: F.ln(x),
    "log10": lambda x: F.log10(x),
    "sqrt": lambda x: F.sqrt(x),
    "sin": lambda x: F.sin(x),
    "cos": lambda x: F.cos(x),
    "tan": lambda x: F.tan(x),
    "asin": lambda x: F.asin(x),
    "acos": lambda x: F.acos(x),
    "atan": lambda x: F.atan(x),
    "atan2": lambda y, x: F.atan2(y, x),
}
