"""Complex numbers as structs (re, im) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_of(re: Column, im: Column | None = None) -> Column:
    return F.struct(re.cast("double").alias("re"), (F.lit(0.0) if im is None else im.cast("double")).alias("im"))


def times(a: Column, b: Column, factor: Column | float = 1.0) -> Column:
    """The product, times a real factor."""
    return complex_of((a["re"] * b["re"] - a["im"] * b["im"]) * factor, (a["re"] * b["im"] + a["im"] * b["re"]) * factor)


def conjugate(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def magnitude(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])
