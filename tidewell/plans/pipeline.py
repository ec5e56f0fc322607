"""Pipelines of named steps over streams: checked when built, then one Spark plan.

A step is a function of a DataFrame with the kind of row it takes and gives (``samples``, ``frames`` or
``packets``). Nothing runs before a sink does, and a tap is one: it runs when the pipeline is put on its source. The runner
hands the composed plan to a writer, for a batch or a stream alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.levels import Dynamics
from tidewell.model import AudioFormat, InvalidData
from tidewell.operators import codecs, forkjoin, framing, processors
from tidewell.sources import files

KINDS = ("samples", "frames", "packets")


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    takes: str = "samples"
    gives: str = "samples"

    def __post_init__(self):
        if self.takes not in KINDS or self.gives not in KINDS:
            raise InvalidData(f"rows are {', '.join(KINDS)}")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df)


class Pipeline:
    """Steps one after another; each must take what the one before gives. Identity steps are left out."""

    def __init__(self, steps: Iterable[Step]):
        steps = list(steps)
        if not steps:
            raise InvalidData("a pipeline needs one step at least")
        for a, b in zip(steps, steps[1:]):
            if a.gives != b.takes:
                raise InvalidData(f"{a.name} gives {a.gives}, {b.name} takes {b.takes}")
        self.takes, self.gives = steps[0].takes, steps[-1].gives
        self.steps = [s for s in steps if s.name != "identity"]

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s(d), self.steps, df)

    def as_step(self, name: str = "pipeline") -> Step:
        return Step(name, self, self.takes, self.gives)

    def run(self, source: DataFrame, sink: Callable[[DataFrame], None]) -> None:
        """A batch from source to sink."""
        sink(self(source))

    def start(self, source: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, **options):
        """A stream from source to sink, batch by batch; steps must be such as work on any part of a stream."""
        writer = source.writeStream.foreachBatch(lambda df, _: sink(self(df))).option("checkpointLocation", checkpoint)
        return writer.options(**options).start()


def _gain(gain: float = 1.0, sample_type: str = "f64"):
    return lambda df: processors.gain(df, gain, sample_type)


def _compressor(sample_rate: float, sample_type: str = "f64", precision: str = "exact", **settings):
    d = Dynamics(sample_rate, **settings)
    return lambda df: processors.compressor(df, d, sample_type, precision)


def _resample(rate_in: int, rate_out: int, out_chunk_samples: int | None = None, pad_final: bool = True, narrow: bool = False, method: str = "linear"):
    if method not in ("linear", "band_limited"):
        raise InvalidData(f"no resampling method {method!r}")

    def run(df: DataFrame) -> DataFrame:
        out = processors.resample(df, rate_in, rate_out, narrow) if method == "linear" else processors.resample_band_limited(df, rate_in, rate_out)
        if out_chunk_samples is None:
            return out
        windows = framing.rechunk(out, out_chunk_samples, "pad" if pad_final else "drop")
        each = windows.select("stream_id", "ch", "first", F.posexplode("values").alias("i", "v"))
        return each.select("stream_id", "ch", (F.col("first") + F.col("i")).alias("n"), "v")

    return run


PROCESSORS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "identity": lambda: processors.identity,
    "gain": _gain,
    "delay": lambda delay_ms, sample_rate, sample_type="f64": lambda df: processors.delay(df, delay_ms, sample_rate, sample_type),
    "fir": lambda taps, sample_type="f64": lambda df: processors.fir(df, taps, sample_type),
    "iir": lambda b, a, sample_type="f64": lambda df: processors.iir(df, b, a, sample_type),
    "compressor": _compressor,
    "resample": _resample,
}


def processor(kind: str, **settings) -> Step:
    """A processor step by its name and settings."""
    if kind not in PROCESSORS:
        raise InvalidData(f"no processor {kind!r}")
    return Step(kind, PROCESSORS[kind](**settings))


def resampler(fmt: AudioFormat, rate_out: int, out_chunk_samples: int, pad_final: bool = True, method: str = "linear") -> Step:
    """Samples to frames of a fixed size of all channels at another rate."""
    return Step("resample", lambda df: processors.resample_frames(df, fmt, rate_out, out_chunk_samples, pad_final, method), "samples", "frames")


def identity(kind: str = "samples") -> Step:
    return Step("identity", lambda df: df, kind, kind)


def encoder(name: str, fmt: AudioFormat, frame_samples: int | None = None, **options) -> Step:
    codecs.codec(name)  # fails now if there is none
    return Step(f"encode {name}", lambda df: codecs.encode(df, name, fmt, frame_samples, **options), "samples", "packets")


def decoder(name: str, fmt: AudioFormat, **options) -> Step:
    codecs.codec(name)
    return Step(f"decode {name}", lambda df: framing.frames_to_samples(codecs.decode(df, name, fmt, **options)), "packets", "samples")


def custom(name: str, run: Callable[[DataFrame], DataFrame], takes: str = "samples", gives: str = "samples") -> Step:
    """A step of one's own; for row-wise Python use ``mapInPandas`` or ``mapInArrow`` inside."""
    return Step(name, run, takes, gives)


def tap(sink: Callable[[DataFrame], None], kind: str = "samples") -> Step:
    """What passes is also given to ``sink``; it is kept for what comes after, so that it is computed once."""
    return Step("tap", lambda df: files.tap(df, sink), kind, kind)


def fork_join(branches: list[Pipeline], reducer: forkjoin.Reducer, sample_type: str = "f64") -> Step:
    """Branches of samples, joined position by position."""
    kinds = {(b.takes, b.gives) for b in branches}
    if kinds != {("samples", "samples")}:
        raise InvalidData("all branches take and give samples")
    return Step("fork and join", lambda df: forkjoin.mix(df, list(branches), reducer, sample_type))
