"""Scalar formulas."""

from __future__ import annotations

import calendar
import functools
import math
import operator
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed physical constants and clamps.
G = 6.674e-11
C = 2.998e8
MSUN = 1.989e30
DFDT_REFERENCE = 1e-4
GPS_EPOCH_S = 315_964_800
# Days on which the offset of GPS time from UTC grew by one second.
LEAP_DAYS = (
    "1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 "
    "1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def chirp_residual(
    mass: Column,
    frequency: Column,
    snr_peak: Column,
    mass_range: tuple[float, float] = (5.0, 100.0),
    frequency_range: tuple[float, float] = (20.0, 2048.0),
) -> Column:
    """Distance of the chirp rate in units of 1e-4 Hz/s from ``log1p(snr)``."""
    m = clamp(mass, *mass_range) * MSUN
    f = clamp(frequency, *frequency_range)
    term = F.pow(m * (math.pi * G / C**3), F.lit(5.0 / 3.0))
    rate = term * F.pow(f, F.lit(11.0 / 3.0)) * (96.0 / (5.0 * math.pi))
    return F.abs(rate / DFDT_REFERENCE - F.log1p(snr_peak))


def log1p_clipped(value: Column) -> Column:
    """``log(1 + x)`` with negative values taken as 0."""
    return F.log1p(F.greatest(value, F.lit(0.0)))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def leap_seconds_at(gps_us: Column) -> Column:
    """Offset of GPS time from UTC in seconds at GPS microseconds."""
    days = [calendar.timegm(time.strptime(day, "%Y-%m-%d")) for day in LEAP_DAYS]
    starts = [(day - GPS_EPOCH_S + n) * 1_000_000 for n, day in enumerate(days, 1)]
    return functools.reduce(operator.add, [(gps_us >= F.lit(s)).cast("long") for s in starts])


def gps_to_timestamp(gps_us: Column, leap_seconds: int | None = None) -> Column:
    """UTC timestamp of GPS microseconds; a stated offset replaces the table of leap seconds."""
    offset = leap_seconds_at(gps_us) if leap_seconds is None else F.lit(leap_seconds)
    return F.timestamp_micros(gps_us + (F.lit(GPS_EPOCH_S).cast("long") - offset) * 1_000_000)
