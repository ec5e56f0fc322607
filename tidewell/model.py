"""Stream formats, schemas and the checks made when a plan is built.

A stream is rows that carry their own order: ``stream_id`` and a position (``n`` for samples, ``seq`` for
frames and packets). Three row shapes are used:

* samples: one value a row, the form that Spark's own functions work on;
* frames: a run of samples of all channels, the form that is read and written;
* packets: encoded bytes with their timing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_BASE = "struct<num:int,den:int>"
FORMAT = "struct<sample_rate:int,channels:int,sample_type:string,planar:boolean,channel_layout_mask:bigint>"
SAMPLES = "stream_id string, ch int, n bigint, v double"
FRAMES = f"stream_id string, seq bigint, pts bigint, time_base {TIME_BASE}, format {FORMAT}, nb_samples int, samples array<array<double>>"
PACKETS = f"stream_id string, seq bigint, data binary, time_base {TIME_BASE}, pts bigint, dts bigint, duration bigint, flags int"

# Bytes a sample of each type takes.
BYTES_PER_SAMPLE = {"u8": 1, "i16": 2, "i32": 4, "i64": 8, "f32": 4, "f64": 8}
# Channel bits of a layout mask.
CHANNEL_BITS = {"FL": 0x1, "FR": 0x2, "FC": 0x4, "LFE": 0x8, "BL": 0x10, "BR": 0x20}
# Names under which codecs and file formats may be asked for.
CODEC_NAMES = {"wav": "wav", "pcm": "wav", "mp3": "mp3", "aac": "aac", "opus": "opus", "flac": "flac"}

# Names of file formats, by the codec they hold.
FILE_FORMATS = {
    "wav": "wav", "mp3": "mp3", "aac": "aac", "aac_adts": "aac", "adts": "aac", "flac": "flac", "opus": "opus", "opus_ogg": "opus", "ogg_opus": "opus",
}


class InvalidData(ValueError):
    """The data do not fit the operator."""


class InvalidState(RuntimeError):
    """An operator was used out of turn."""


class Unsupported(RuntimeError):
    """A back end that is not there, or a format it does not take."""


@dataclass(frozen=True)
class Rational:
    num: int
    den: int

    @property
    def valid(self) -> bool:
        return self.den != 0


def default_layout_mask(channels: int) -> int:
    return {1: CHANNEL_BITS["FC"], 2: CHANNEL_BITS["FL"] | CHANNEL_BITS["FR"]}.get(channels, 0)


@dataclass(frozen=True)
class AudioFormat:
    sample_rate: int
    channels: int
    sample_type: str = "f32"
    planar: bool = True
    channel_layout_mask: int | None = field(default=None)

    def __post_init__(self):
        if self.sample_rate <= 0 or self.channels <= 0:
            raise InvalidData("sample rate and channels must be positive")
        if self.sample_type not in BYTES_PER_SAMPLE:
            raise InvalidData(f"no sample type {self.sample_type!r}")
        if self.channel_layout_mask is None:
            object.__setattr__(self, "channel_layout_mask", default_layout_mask(self.channels))

    @property
    def bytes_per_sample(self) -> int:
        return BYTES_PER_SAMPLE[self.sample_type]

    def plane_bytes(self, nb_samples: int) -> int:
        return self.bytes_per_sample * nb_samples * (1 if self.planar else self.channels)

    def time_base(self) -> Rational:
        return Rational(1, self.sample_rate)

    def column(self) -> Column:
        return F.struct(
            F.lit(self.sample_rate).alias("sample_rate"),
            F.lit(self.channels).alias("channels"),
            F.lit(self.sample_type).alias("sample_type"),
            F.lit(self.planar).alias("planar"),
            F.lit(self.channel_layout_mask).cast("bigint").alias("channel_layout_mask"),
        )

    def difference(self, other: AudioFormat) -> str:
        """What differs, in words; empty for equal formats."""
        names = ("sample_rate", "channels", "sample_type", "planar", "channel_layout_mask")
        return ", ".join(f"{k}: expected {getattr(self, k)}, got {getattr(other, k)}" for k in names if getattr(self, k) != getattr(other, k))


def check_one_format(frames: DataFrame, expected: AudioFormat | None = None) -> DataFrame:
    """``frames`` without empty ones; a stream whose frames differ in format (or from ``expected``) fails when it is read.

    The formats of a stream are one small aggregate, which goes back to the frames by the stream's id.
    """
    frames = frames.where("nb_samples > 0")
    if expected is not None:
        same = F.col("format") == expected.column()
        return frames.withColumn("format", F.when(same, F.col("format")).otherwise(F.raise_error("frames differ from the stream's format")))
    first = frames.groupBy("stream_id").agg(F.min("format").alias("low_"), F.max("format").alias("high_"))
    told = frames.join(first, "stream_id")
    checked = F.when(F.col("low_") == F.col("high_"), F.col("format")).otherwise(F.raise_error("a stream's frames differ in format"))
    return told.withColumn("format", checked).drop("low_", "high_")


def rescale_pts(pts: Column, base_in: Rational, base_out: Rational) -> Column:
    """A time stamp in another time base, cut toward zero; null for a zero denominator or beyond 64 bits."""
    up, down = base_in.num * base_out.den, base_in.den * base_out.num
    if not base_in.valid or not base_out.valid or down == 0:
        return F.lit(None).cast("bigint")
    up, down = (-up, -down) if down < 0 else (up, down)
    shared = math.gcd(up, down)
    up, down = up // shared, down // shared
    # whole numbers and rest apart, so that no step leaves 64 bits unless the result does
    whole = F.try_multiply(F.call_function("div", pts, F.lit(down)), F.lit(up))
    rest = F.try_multiply(pts % F.lit(down), F.lit(up))
    return F.try_add(whole, F.call_function("div", rest, F.lit(down)))


def delay_samples(delay_ms: float, sample_rate: int) -> int:
    """A delay in samples, halves away from zero."""
    d = delay_ms * sample_rate / 1000
    if sample_rate <= 0 or not math.isfinite(d) or d < 0:
        raise InvalidData("delay and sample rate must be finite and not negative")
    return math.floor(d + 0.5)


def resampled_length(n: int, rate_in: int, rate_out: int) -> int:
    if rate_in <= 0 or rate_out <= 0:
        raise InvalidData("sample rates must be positive")
    return n if n < 2 or rate_in == rate_out else max(1, (n * rate_out + rate_in // 2) // rate_in)
