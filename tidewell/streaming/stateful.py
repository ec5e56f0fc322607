"""Streaming forms: state by stream and channel, the same kernels as the batch operators.

A micro-batch brings rows in any order, so each call sorts what it got, appends what earlier calls kept, and
handles the samples that follow without a gap; later ones wait in the state. A row with ``n`` null ends its stream:
what an operator still holds is then given out and its state cleared (there is no end of a key otherwise).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions.levels import Dynamics, offset_of
from tidewell.model import InvalidData, delay_samples
from tidewell.operators import processors

OUT = "stream_id string, ch int, n bigint, v double"
#: next position, memory of the operator, samples that wait for a gap to close
STATE = "next bigint, memory array<double>, wait_n array<bigint>, wait_v array<double>"

#: A kernel: (values, memory, first position) -> (positions from, values, memory).
Kernel = Callable[[np.ndarray, list, int], tuple[int, np.ndarray, list]]
#: What is left at the end: (memory, next position) -> (position from, values).
Ending = Callable[[list, int], tuple[int, np.ndarray]]


def _nothing(memory: list, position: int) -> tuple[int, np.ndarray]:
    return position, np.zeros(0)


def stateful(samples: DataFrame, kernel: Kernel, ending: Ending = _nothing) -> DataFrame:
    """Apply ``kernel`` along each channel of a stream of samples (stream_id, ch, n, v)."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, memory, wait_n, wait_v = state.get if state.exists else (0, [], [], [])
        got = pd.concat(list(frames))
        ends = bool(got["n"].isna().any())
        got = got[got["n"].notna()]
        n = np.concatenate([np.asarray(wait_n, np.int64), got["n"].to_numpy().astype(np.int64)])
        v = np.concatenate([np.asarray(wait_v, float), got["v"].to_numpy(float)])
        order = np.argsort(n, kind="stable")
        n, v = n[order], v[order]
        fresh = n >= position
        n, v = n[fresh], v[fresh]
        if len(n):
            once = np.append(True, n[1:] != n[:-1])
            n, v = n[once], v[once]
        ready = n == position + np.arange(len(n))
        memory = list(memory)
        parts = []
        if ready.any():
            first, values, memory = kernel(v[ready], memory, position)
            parts.append((first, values))
            position += int(ready.sum())
        if ends:
            parts.append(ending(memory, position))
            state.remove()
        else:
            state.update((int(position), [float(x) for x in memory], n[~ready].tolist(), v[~ready].tolist()))
        for first, values in parts:
            if len(values):
                yield pd.DataFrame({"stream_id": key[0], "ch": np.int32(key[1]), "n": np.arange(first, first + len(values), dtype=np.int64), "v": values})

    return samples.groupBy("stream_id", "ch").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Step:
    """An operator along a channel: its kernel, and what it gives out at the end."""

    kernel: Kernel
    ending: Ending = _nothing


def passing() -> Step:
    return Step(lambda x, memory, position: (position, x, memory))


def mapping(f: Callable[[np.ndarray], np.ndarray]) -> Step:
    """A function of values, each by itself."""
    return Step(lambda x, memory, position: (position, f(x), memory))


def delaying(delay_ms: float, sample_rate: int, sample_type: str = "f64") -> Step:
    d = delay_samples(delay_ms, sample_rate)

    def kernel(x, memory, position):
        if position == 0:
            return 0, np.concatenate([np.full(d, offset_of(sample_type)), x]), memory
        return position + d, x, memory

    return Step(kernel)


def delay(samples: DataFrame, delay_ms: float, sample_rate: int, sample_type: str = "f64") -> DataFrame:
    return along(samples, delaying(delay_ms, sample_rate, sample_type))


def convolving(taps) -> Step:
    h = np.array(processors.check_coefficients(taps, "taps"))

    def kernel(x, memory, position):
        past = np.array(memory or [0.0] * (len(h) - 1))
        line = np.concatenate([past, np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)])
        return position, np.convolve(line, h)[len(past) : len(line)], line[len(line) - (len(h) - 1) :].tolist()

    return Step(kernel)


def fir(samples: DataFrame, taps) -> DataFrame:
    return along(samples, convolving(taps))


def feeding_back(b, a) -> Step:
    b, a = processors.check_coefficients(b, "b"), processors.check_coefficients(a, "a")
    b, a = [x / a[0] for x in b], [x / a[0] for x in a]

    def kernel(x, memory, position):
        back = len(b) - 1
        past_x, past_y = memory[:back], memory[back:] or [0.0] * (len(a) - 1)
        y, px, py = processors.recursive(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), b, a, past_x, past_y)
        px = (px[:back] + [0.0] * back)[:back]
        return position, y, px + py

    return Step(kernel)


def iir(samples: DataFrame, b, a) -> DataFrame:
    return along(samples, feeding_back(b, a))


def compressing(dynamics: Dynamics, sample_type: str = "f64", precision: str = "exact") -> Step:
    def kernel(x, memory, position):
        y, env = processors.compress_values(x, dynamics, sample_type, precision, memory[0] if memory else 0.0)
        return position, y, [env]

    return Step(kernel)


def compressor(samples: DataFrame, dynamics: Dynamics, sample_type: str = "f64", precision: str = "exact") -> DataFrame:
    return along(samples, compressing(dynamics, sample_type, precision))


def resampling(rate_in: int, rate_out: int) -> Step:
    """Linear interpolation; the end of a stream holds its last sample for the outputs that are still due."""
    if rate_in <= 0 or rate_out <= 0:
        raise InvalidData("sample rates must be positive")
    step = rate_in / rate_out

    def first_output(position: int) -> int:
        """The first output whose place is not before ``position``."""
        k = max(0, int(position / step) - 2)
        while k * step < position:
            k += 1
        return k

    def kernel(x, memory, position):
        line = np.concatenate([memory, x])
        start = position - len(memory)
        last = position + len(x) - 1
        low, high = first_output(start), first_output(last)  # places in [start, last) have both neighbours
        at = np.arange(low, high) * step
        i = np.floor(at).astype(np.int64)
        a, b = line[i - start], line[np.minimum(i - start + 1, len(line) - 1)]
        return low, a + (b - a) * (at - i), [float(line[-1])]

    def ending(memory, position):
        if not memory:
            return 0, np.zeros(0)
        due = position if position < 2 else max(1, (position * rate_out + rate_in // 2) // rate_in)
        low = first_output(position - 1)
        return low, np.full(max(0, due - low), memory[0])

    return Step(kernel, ending)


def resample(samples: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    return along(samples, resampling(rate_in, rate_out))


def windowing(size: int, tail: str = "emit") -> Step:
    """Samples held back until their count window is full; at the end the rest is emitted, dropped or padded."""

    def kernel(x, memory, position):
        line = np.concatenate([memory, x])
        whole = len(line) // size * size
        return position - len(memory), line[:whole], line[whole:].tolist()

    def ending(memory, position):
        rest = np.array(memory)
        if tail == "drop" or not len(rest):
            return position, np.zeros(0)
        first = position - len(rest)
        return first, np.concatenate([rest, np.zeros(size - len(rest))]) if tail == "pad" else rest

    return Step(kernel, ending)


def rechunk(samples: DataFrame, size: int, tail: str = "emit") -> DataFrame:
    return along(samples, windowing(size, tail))


def along(samples: DataFrame, step: Step) -> DataFrame:
    return stateful(samples, step.kernel, step.ending)


def to_sinks(stream: DataFrame, sinks, checkpoint: str, **options):
    """Every micro-batch to all sinks; it is computed once, and an error of any sink fails the query."""
    from tidewell.sources.files import fan_out

    return stream.writeStream.foreachBatch(lambda df, _: fan_out(df, sinks)).option("checkpointLocation", checkpoint).options(**options).start()
