"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibel(power: Column, ref: Column | float = 1.0, least: float = 1e-20) -> Column:
    """10 log10(power / ref); powers under ``least`` give minus infinity, null stays null."""
    ref = F.lit(ref) if isinstance(ref, (int, float)) else ref
    return F.when(power < least, F.lit(float("-inf"))).otherwise(10 * F.log10(power / ref))


def adjust_q10(freq: Column, temp: Column, t_ref: float = 25.0, q10: float = 1.62) -> Column:
    """Frequency at ``t_ref`` degrees; unchanged where the temperature is unknown."""
    known = temp.isNotNull() & ~F.isnan(temp)
    return F.when(known, freq * F.pow(F.lit(q10), (t_ref - temp) / 10)).otherwise(freq)


def near_multiple(freq: Column, base: float, tol: float) -> Column:
    """Whether a frequency is closer than ``tol`` to a multiple of ``base``."""
    return F.abs(freq - F.round(freq / base) * base) < tol


def base_name(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
