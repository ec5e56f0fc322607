"""Decibels, envelope coefficients, the dynamics curve and saturating conversions, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import InvalidData

# Range and offset of the integer sample types.
RANGES = {"u8": (0, 255), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1)}
# What an integer sample is divided by to be within one.
FULL_SCALE = {"u8": 128.0, "i16": 32768.0, "i32": 2147483648.0, "i64": 9223372036854775808.0}


def db_to_lin(db: Column) -> Column:
    return F.pow(F.lit(10.0), db * 0.05)


def lin_to_db(x: Column) -> Column:
    """Silence is minus infinity and a negative value no number, where Spark's logarithm gives null for both."""
    return F.when(x > 0, F.log10(x) * 20.0).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def time_coefficient(seconds: float, sample_rate: float) -> float:
    """Weight of the previous envelope for a time constant; zero for none."""
    if not math.isfinite(seconds) or seconds <= 0 or not math.isfinite(sample_rate) or sample_rate <= 0:
        return 0.0
    return math.exp(-1 / (seconds * sample_rate))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


@dataclass(frozen=True)
class Dynamics:
    """Settings of a compressor and expander."""

    sample_rate: float
    threshold_db: float = -18.0
    knee_width_db: float = 6.0
    ratio: float = 4.0
    expansion_ratio: float = 2.0
    expansion_threshold_db: float = -60.0
    attack_time: float = 0.01
    release_time: float = 0.1
    master_gain_db: float = 0.0

    def __post_init__(self):
        bad = [k for k, v in vars(self).items() if not math.isfinite(v)]
        bad += [k for k in ("ratio", "expansion_ratio") if getattr(self, k) < 1]
        bad += [k for k in ("knee_width_db", "attack_time", "release_time") if getattr(self, k) < 0]
        bad += ["sample_rate"] * (self.sample_rate <= 0)
        if bad:
            raise InvalidData(f"out of range: {', '.join(bad)}")

    @property
    def attack(self) -> float:
        return time_coefficient(self.attack_time, self.sample_rate)

    @property
    def release(self) -> float:
        return time_coefficient(self.release_time, self.sample_rate)


def curve_db(level: Column, d: Dynamics) -> Column:
    """Gain in decibels at a level: expansion below its threshold, else soft-knee compression."""
    slope = 1 / d.ratio - 1
    over = level - d.threshold_db
    hard = F.when(over <= 0, 0.0).otherwise(over * slope)
    w = d.knee_width_db
    if w > 0:
        into = over + w / 2
        hard = F.when(into < 0, 0.0).when(over > w / 2, over * slope).otherwise(into * into * (slope / (2 * w)))
    if d.expansion_ratio > 1:
        below = level - d.expansion_threshold_db
        return F.when(below < 0, below * (d.expansion_ratio - 1)).otherwise(hard)
    return hard


def quantise(v: Column, sample_type: str) -> Column:
    """A value in the raw units of a type: no number becomes silence, the rest is clamped and rounded half away from zero."""
    if sample_type == "f64":
        return v
    if sample_type == "f32":
        return v.cast("float").cast("double")
    low, high = RANGES[sample_type]
    silence = 128.0 if sample_type == "u8" else 0.0
    held = F.greatest(F.least(F.when(F.isnan(v), silence).otherwise(v), F.lit(float(high))), F.lit(float(low)))
    return F.round(held)


def to_integer(v: Column, sample_type: str) -> Column:
    """The same as a whole number; the largest 64-bit value is set by hand, since a double cannot hold it."""
    q = quantise(v, sample_type)
    if sample_type == "i64":
        return F.when(q >= float(2**63), F.lit(2**63 - 1)).otherwise(F.try_cast(q, "bigint") if hasattr(F, "try_cast") else q.try_cast("bigint"))
    return q.cast("int")


def offset_of(sample_type: str) -> float:
    """The value that stands for silence."""
    return 128.0 if sample_type == "u8" else 0.0


def normalise(v: Column, sample_type: str) -> Column:
    """Raw units to the domain of reducers: integers within one, floats as they are."""
    return v if sample_type in ("f32", "f64") else (v - offset_of(sample_type)) / FULL_SCALE[sample_type]


def denormalise(v: Column, sample_type: str) -> Column:
    """Back to raw units; integers are clamped to one before they are scaled, floats are not."""
    if sample_type in ("f32", "f64"):
        return quantise(v, sample_type)
    held = F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))
    held = F.when(F.isnan(v), F.lit(float("nan"))).otherwise(held)
    return quantise(held * FULL_SCALE[sample_type] + offset_of(sample_type), sample_type)


def wav_to_float(v: Column) -> Column:
    """16-bit file samples as they are read."""
    return v / 32768.0


def float_to_wav(v: Column) -> Column:
    """16-bit file samples as they are written: the scale differs from reading by one step, as files expect."""
    held = F.greatest(F.least(F.when(F.isnan(v), 0.0).otherwise(v), F.lit(1.0)), F.lit(-1.0))
    return F.round(held * 32767.0).cast("int")
