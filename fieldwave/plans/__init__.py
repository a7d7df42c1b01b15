"""Queries that bind the operators to the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events, files, frequencies, kernels, logger, pulse_jobs, shapes, tables, waveforms

_MODULES = (logger, tables, frequencies, events, waveforms, kernels, files, shapes, pulse_jobs)


#: Rounded columns that may come out as minus zero on one side only; both sides turn it into zero.
_SIGNED = {
    "m3_pulse_train": ["v"],
    "m4_fourier_coeffs": ["re", "im"],
    "m4_fourier_synthesis": ["v"],
    "m6_condition_wave": ["re", "im"],
    "m7_unfilter": ["v"],
    "m8_unfilter_coeffs": ["re", "im"],
    "m12_align_snippets": ["v"],
    "w7_relative_power": ["relpower"],
    "w18_derivatives": ["d1", "d2"],
    "w19_condition_pulse": ["v"],
    "p2_decibel": ["db"],
    "p10_unwrap_clipped": ["v"],
    "p11_subtract_slope": ["v"],
    "p12_normalize_waveform": ["v"],
    "a7_mean_waveform": ["mean"],
    "a11_pulse_properties": ["ppdist", "polaritybalance"],
    "a12_wave_properties": ["ppdist"],
    "a13_harmonic_spectrum": ["relpower", "phase"],
    "a13_spectrum_summary": ["power", "phaseslope"],
    "j6_freq_diffs": ["diff"],
    "j7_freq_intervals": ["deviation", "rel_deviation"],
}


def _unsigned(query: Callable[[SparkSession, str], DataFrame], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})

    return run


def _unsigned_sql(sql: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = 0 THEN 0::DOUBLE ELSE {c} END AS {c}' for c in columns)}) FROM ({sql})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
    return {name: _unsigned(f, _SIGNED[name]) if name in _SIGNED else f for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
    return {name: _unsigned_sql(sql, _SIGNED[name]) if name in _SIGNED else sql for name, sql in found.items()}
