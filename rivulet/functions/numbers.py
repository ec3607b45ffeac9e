"""Column functions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def out(x: Column, places: int = 4) -> Column:
    """Rounds an output; the small addend keeps means that end in an exact 5 from rounding either way."""
    return F.round(x + 1e-9, places)


def exact(x: Column) -> Column:
    """Rounds a mean that enters further formulas."""
    return F.round(x, 9)


def entropy(p: Column) -> Column:
    """Of a coin, in nats; 0 ln 0 is 0."""
    term = lambda q: F.when(q > 0, q * F.ln(q)).otherwise(0.0)
    return -(term(p) + term(1 - p))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, the same in every engine that has md5."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


# The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, at most 7."""
    total = F.lit(0)
    for bound in POISSON_ONE:
        total = total + (u >= bound).cast("int")
    return total


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0))
