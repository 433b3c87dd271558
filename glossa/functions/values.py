"""Value functions applied to ``group_norm`` (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The value-function names and formulas of the feature tables
# (identity, square root, log(d + 1), Anscombe 2*sqrt(d + 3/8), boolean).
# Lexicon tables use the base-2 logarithm.


def value_func(name: str, c: Column, lexicon: bool = False) -> Column:
    if name in (None, "", "identity", "none"):
        return c
    if name == "sqrt":
        return F.sqrt(c)
    if name == "log":
        return F.log2(c + F.lit(1.0)) if lexicon else F.log1p(c)
    if name == "anscombe":
        return F.lit(2.0) * F.sqrt(c + F.lit(3.0 / 8.0))
    if name == "boolean":
        return F.lit(1.0)
    raise ValueError(f"unknown value function {name!r}")


VALUE_FUNCS = ("identity", "sqrt", "log", "anscombe", "boolean")
