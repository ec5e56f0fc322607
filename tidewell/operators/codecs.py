"""Frames to packets and back.

PCM is built in. Lossy codecs need a library of their own: one can be registered, and without it they are
unsupported, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import CODEC_NAMES, AudioFormat, InvalidData, Unsupported, check_one_format

# How samples of each type stand in bytes.
NUMPY_TYPES = {"u8": "u1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}
# Samples a frame of each encoder, and bits a second of the lossy ones.
FRAME_SAMPLES = {"wav": 1024, "mp3": 1152, "aac": 1024, "opus": 960, "flac": 4096}
BITRATES = {"mp3": 128_000, "opus": 96_000}


@dataclass(frozen=True)
class Codec:
    """Frames to packets and packets to frames."""

    encode: Callable[..., DataFrame]
    decode: Callable[..., DataFrame]


_registered: dict[str, Codec] = {}


def register(name: str, codec: Codec) -> None:
    _registered[CODEC_NAMES[name]] = codec


def codec(name: str) -> Codec:
    known = CODEC_NAMES.get(name.lower())
    if known is None:
        raise InvalidData(f"no codec {name!r}")
    if known not in _registered:
        raise Unsupported(f"no back end for {known} is registered")
    return _registered[known]


def to_bytes(planes, fmt: AudioFormat) -> bytes:
    """Channels' values as bytes, interleaved."""
    values = np.array([np.asarray(p, float) for p in planes]).T
    kind = np.dtype(NUMPY_TYPES[fmt.sample_type])
    if kind.kind != "f":
        info = np.iinfo(kind)
        silence = 128 if fmt.sample_type == "u8" else 0
        values = np.where(np.isnan(values), silence, values)
        whole = np.where(values < 0, -np.floor(-values + 0.5), np.floor(values + 0.5))
        held = np.clip(whole, float(info.min), float(info.max))
        top = held >= float(info.max)
        values = np.where(top, 0, held).astype(kind)
        values[top] = info.max
    return values.astype(kind).tobytes()


def from_bytes(data: bytes, fmt: AudioFormat) -> list[list[float]]:
    step = fmt.channels * fmt.bytes_per_sample
    if len(data) % step:
        raise InvalidData("the bytes are no whole number of samples")
    return np.frombuffer(data, NUMPY_TYPES[fmt.sample_type]).reshape(-1, fmt.channels).T.astype(float).tolist()


def encode_pcm(frames: DataFrame, fmt: AudioFormat) -> DataFrame:
    """A packet a frame: its samples' bytes; time stamps are kept and the duration is the number of samples."""

    @F.pandas_udf("binary")
    def encoded(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: to_bytes(p, fmt))

    return frames.select(
        "stream_id", "seq", encoded("samples").alias("data"), "time_base", "pts", F.col("pts").alias("dts"), F.col("nb_samples").cast("bigint").alias("duration"), F.lit(0).alias("flags")
    )


def decode_pcm(packets: DataFrame, fmt: AudioFormat) -> DataFrame:
    if fmt.planar:
        raise InvalidData("packets hold interleaved samples")

    @F.pandas_udf("array<array<double>>")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda d: from_bytes(d, fmt))

    out = packets.withColumn("samples", decoded("data")).withColumn("format", fmt.column())
    return out.select("stream_id", "seq", "pts", "time_base", "format", (F.length("data") / (fmt.channels * fmt.bytes_per_sample)).cast("int").alias("nb_samples"), "samples")


def decode_pcm_unit(packets: DataFrame, fmt: AudioFormat, chunk_samples: int | None = None) -> DataFrame:
    """Frames of raw PCM packets as 32-bit floats within one, in windows of ``chunk_samples`` if given."""
    from tidewell.operators.framing import frames_to_samples, samples_to_frames
    from tidewell.operators.processors import convert

    samples = convert(frames_to_samples(decode_pcm(packets, fmt)), fmt.sample_type, "f32")
    unit = AudioFormat(fmt.sample_rate, fmt.channels, "f32", planar=False)
    return samples_to_frames(samples, unit, chunk_samples or FRAME_SAMPLES["wav"])


register("wav", Codec(encode_pcm, decode_pcm))


def frame_samples_of(name: str, frame_samples: int | None = None) -> int:
    """Samples of an encoder's frame: what is asked for, or the codec's own."""
    known = CODEC_NAMES.get(name.lower())
    if known is None:
        raise InvalidData(f"no codec {name!r}")
    return frame_samples or FRAME_SAMPLES[known]


def encode(samples: DataFrame, name: str, fmt: AudioFormat, frame_samples: int | None = None, force: bool = True, **options) -> DataFrame:
    """Packets of a sample stream: count windows of the encoder's frame.

    With ``force`` the last is as short as it comes; without, what does not fill a frame is kept back (``pending`` says how much).
    """
    from tidewell.operators.framing import samples_to_frames

    known = codec(name)
    if CODEC_NAMES[name.lower()] == "opus" and fmt.sample_rate != 48_000:
        raise InvalidData("opus takes 48000 samples a second")
    return known.encode(samples_to_frames(samples, fmt, frame_samples_of(name, frame_samples), "emit" if force else "drop"), fmt, **options)


def pending(samples: DataFrame, name: str, frame_samples: int | None = None, taken: int = 0) -> DataFrame:
    """stream_id, pending_samples, state of each stream's encoder after ``taken`` packets were taken out of it.

    The state is ``ready`` while a whole frame is there, ``need_more`` while some samples are, and ``empty``.
    """
    size = frame_samples_of(name, frame_samples)
    held = samples.groupBy("stream_id").agg((F.max("n") + 1).alias("got"))
    left = F.greatest(F.col("got") - F.least(F.floor(F.col("got") / size), F.lit(taken)) * size, F.lit(0)).cast("bigint")
    state = F.when(F.col("left") == 0, "empty").when(F.col("left") < size, "need_more").otherwise("ready")
    return held.select("stream_id", left.alias("left")).select("stream_id", F.col("left").alias("pending_samples"), state.alias("state"))


def decode(packets: DataFrame, name: str, fmt: AudioFormat, chunk_samples: int | None = None, force: bool = True, **options) -> DataFrame:
    """Frames of a packet stream, in windows of ``chunk_samples`` if given; the last as short as it comes, or kept back without ``force``.

    A frame of another format than ``fmt`` is an error when it is read.
    """
    from tidewell.operators.framing import frames_to_samples, samples_to_frames

    frames = check_one_format(codec(name).decode(packets, fmt, **options), fmt)
    return frames if chunk_samples is None else samples_to_frames(frames_to_samples(frames), fmt, chunk_samples, "emit" if force else "drop")
