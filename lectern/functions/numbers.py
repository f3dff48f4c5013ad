"""Rounding of published metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From which value on a double is a whole multiple of 1 / unit, so that no bit of it is lost.
_UNITS = [(2.0**-8, 1 << 60), (2.0**-16, 1 << 68), (0.0, 1 << 76)]


def rounded_sql(x: str, digits: int, whole: str = "DECIMAL(24,0)", divide: str = "div") -> str:
    """SQL that rounds a double x from 0 to below 8 to so many decimals, by its exact binary value, ties to even.

    Built-in rounding looks at a double's shortest decimal form, which can be a tie where the value is none.
    whole is a type that holds 2 ** 76, divide its integer division.
    """
    one_of = lambda f: "(CASE " + " ".join(f"WHEN {x} >= {low!r} THEN {f(u)}" for low, u in _UNITS) + " END)"
    unit = one_of(lambda u: f"CAST('{u}' AS {whole})")
    shown = f"(CAST(floor({one_of(lambda u: f'{x} * CAST({float(u)!r} AS DOUBLE)')}) AS {whole}) * CAST({10**digits} AS {whole.replace('24', '7')}))"
    down = f"({shown} {divide} {unit})"
    rest = f"(({shown} - CAST({down} AS {whole}) * {unit}) * 2)"
    return f"(CAST({down} + CASE WHEN {rest} > {unit} OR ({rest} = {unit} AND {down} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / CAST({10**digits} AS DOUBLE))"


def rounded(column: str, digits: int) -> Column:
    """A column rounded as rounded_sql() says."""
    return F.expr(rounded_sql(f"`{column}`", digits)).alias(column)
