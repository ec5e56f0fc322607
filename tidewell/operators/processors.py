"""Sample processors: samples in, samples out, one plan for batches.

Samples are values in the raw units of their type (``sample_type``). Channels never meet, so the unit of
work is a block of one channel's positions. Operators with a short memory borrow it from the block
before; the recursive filter passes its state from block to block by a small affine map; the compressor,
whose memory fades, borrows as many samples as it takes for the fading to pass below 1e-12.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.levels import FULL_SCALE, Dynamics, offset_of, quantise
from tidewell.model import AudioFormat, InvalidData, delay_samples, resampled_length
from tidewell.operators.framing import BLOCK, samples_to_frames, with_halo

SCHEMA = "stream_id string, ch int, n bigint, v double"
#: Samples of a block of a filter in parts, at least.
PART_SAMPLES = 1 << 14
#: Taps up to which a filter is a sum of shifted columns; more are a convolution of arrays.
FEW_TAPS = 16


def identity(samples: DataFrame) -> DataFrame:
    return samples


def gain(samples: DataFrame, factor: float, sample_type: str = "f64") -> DataFrame:
    """Each value times ``factor``; infinities stay, no number becomes silence."""
    if not math.isfinite(factor):
        raise InvalidData("gain must be finite")
    return samples.withColumn("v", gained(F.col("v"), factor, sample_type))


def gained(v: Column, factor: float, sample_type: str) -> Column:
    zero = offset_of(sample_type)
    out = (v - zero) * factor + zero
    if sample_type in ("f32", "f64"):
        out = F.when(F.isnan(v) | F.isnan(out), 0.0).otherwise(out)
    return quantise(out, sample_type)


def delay(samples: DataFrame, delay_ms: float, sample_rate: int, sample_type: str = "f64") -> DataFrame:
    """Silence before each channel; every sample keeps its value and moves up."""
    d = delay_samples(delay_ms, sample_rate)
    if d == 0:
        return samples
    moved = samples.withColumn("n", F.col("n") + d)
    silence = samples.where("n = 0").select("stream_id", "ch", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("n"))
    silence = silence.select("stream_id", "ch", F.col("n").cast("bigint").alias("n"), F.lit(offset_of(sample_type)).alias("v"))
    return silence.unionByName(moved.select("stream_id", "ch", "n", "v"))


def delay_frames(frames: DataFrame, delay_ms: float, sample_rate: int) -> DataFrame:
    """Frame sizes after a delay: those that came in, and one frame of what is left; time stamps move back by the delay."""
    d = delay_samples(delay_ms, sample_rate)
    shifted = frames.select("stream_id", "seq", (F.col("pts") - d).alias("pts"), "nb_samples")
    ends = frames.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"), F.max(F.struct("seq", (F.col("pts") + F.col("nb_samples") - d).alias("p")))["p"].alias("pts"))
    tail = ends.select("stream_id", "seq", "pts", F.lit(d).alias("nb_samples"))
    return shifted.unionByName(tail) if d else shifted


def finite(v: Column) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def check_coefficients(values, name: str) -> list[float]:
    """Coefficients as they are held: 32-bit numbers."""
    if not len(values) or not all(map(math.isfinite, values)):
        raise InvalidData(f"{name} must be finite, one at least")
    return [float(np.float32(x)) for x in values]


def fir(samples: DataFrame, taps, sample_type: str = "f64", block: int = BLOCK) -> DataFrame:
    """Convolution with ``taps``, from silence; the result does not depend on how frames were cut."""
    h = check_coefficients(taps, "taps")
    zero = offset_of(sample_type)
    if len(h) > block:
        return fir_in_parts(samples.withColumn("v", finite(F.col("v") - zero)), np.array(h), block).withColumn("v", quantise(finite(F.col("v")) + zero, sample_type))
    blocks = with_halo(samples.withColumn("v", finite(F.col("v") - zero)), len(h) - 1, block=block)
    order = Window.partitionBy("stream_id", "ch", "block_").orderBy("n")
    if len(h) <= FEW_TAPS or len(set(h)) == 1:
        if len(set(h)) == 1 and len(h) > 1:
            y = F.sum("v").over(order.rowsBetween(-(len(h) - 1), 0)) * h[0]
        else:
            y = sum((F.coalesce(F.lag("v", k).over(order), F.lit(0.0)) if k else F.col("v")) * c for k, c in enumerate(h))
        return blocks.withColumn("v", quantise(finite(y) + zero, sample_type)).where("own_").select("stream_id", "ch", "n", "v")
    kernel = np.array(h)

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = pdf["v"].to_numpy()
        size = 1 << (len(x) + len(kernel) - 2).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(kernel, size), size)[: len(x)] if len(x) > 512 else np.convolve(x, kernel)[: len(x)]
        pdf["v"] = y
        return pdf[pdf["own_"]][["stream_id", "ch", "n", "v"]]

    out = blocks.groupBy("stream_id", "ch", "block_").applyInPandas(convolve, SCHEMA)
    return out.withColumn("v", quantise(finite(F.col("v")) + zero, sample_type))


def fir_in_parts(samples: DataFrame, h: np.ndarray, size: int) -> DataFrame:
    """Convolution with more taps than a block holds: taps in parts of ``size``, each a filter of the signal moved up by the taps before it.

    A task holds a block of one part and what it looks back on, whatever the number of taps; what the parts give at a position is summed, partially
    before it moves. Blocks hold ``PART_SAMPLES`` at least, however short the parts are.
    """
    wide = max(size, PART_SAMPLES)
    parts = F.explode(F.sequence(F.lit(0), F.lit((len(h) - 1) // size))).alias("part_")
    moved = samples.select("stream_id", "ch", "n", "v", parts).withColumn("n", F.col("n") + F.col("part_") * size)
    blocks = with_halo(moved, size - 1, block=wide)
    schema = f"{SCHEMA}, own bigint"

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        part = int(pdf["part_"].iloc[0])
        at = int(pdf["block_"].iloc[0]) * wide
        line = np.zeros(wide + size - 1)
        line[pdf["n"].to_numpy() - at + size - 1] = pdf["v"].to_numpy()
        kernel = h[part * size : (part + 1) * size]
        n = 1 << (wide + size + len(kernel)).bit_length()
        y = np.fft.irfft(np.fft.rfft(line, n) * np.fft.rfft(kernel, n), n)[size - 1 : wide + size - 1]
        last = int(pdf["n"].iloc[-1]) - at + size  # nothing is given beyond what the block's samples reach
        out = pd.DataFrame({"n": np.arange(at, at + wide), "v": y})[:last]
        # the first part's own samples say how long the channel is
        out["own"] = np.isin(out["n"], pdf["n"][pdf["own_"]]).astype(np.int64) if part == 0 else 0
        return out.assign(stream_id=pdf["stream_id"].iloc[0], ch=pdf["ch"].iloc[0])[["stream_id", "ch", "n", "v", "own"]]

    made = blocks.groupBy("stream_id", "ch", "part_", "block_").applyInPandas(convolve, schema)
    met = made.groupBy("stream_id", "ch", "n").agg(F.sum("v").alias("v"), F.max("own").alias("own"))
    return met.where("own = 1").select("stream_id", "ch", "n", "v")


#: Samples that the recursive filter makes at once.
STRIP = 64


@lru_cache(64)
def strip_responses(a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What each input of a strip, and each remembered output (most recent first), adds to the strip's outputs."""
    order = len(a) - 1
    impulse = np.zeros(STRIP)
    for i in range(STRIP):
        impulse[i] = float(i == 0) - sum(a[k] * impulse[i - k] for k in range(1, min(order, i) + 1))
    inputs = np.array([np.concatenate([np.zeros(i), impulse[: STRIP - i]]) for i in range(STRIP)]).T
    # a remembered output enters as the feedback of the first samples of the strip
    fed = np.zeros((STRIP, order))
    for j in range(order):
        for i in range(min(order - j, STRIP)):
            fed[i, j] = -a[i + j + 1]
    return inputs, inputs @ fed


def recursive(x: np.ndarray, b: list[float], a: list[float], past_x: list[float], past_y: list[float]) -> tuple[np.ndarray, list[float], list[float]]:
    """Output of the recursive filter and its memory (most recent first) after ``x``. Strips of samples are made by matrices."""
    order, back = len(a) - 1, len(b) - 1
    line = np.concatenate([(list(past_x) + [0.0] * back)[:back][::-1], x])
    u = np.convolve(line, b)[back : back + len(x)] if len(x) else np.zeros(0)
    state = np.array((list(past_y) + [0.0] * order)[:order])
    out = u.copy()
    if order:
        with np.errstate(all="ignore"):
            inputs, remembered = strip_responses(tuple(a))
            for at in range(0, len(x), STRIP):
                part = u[at : at + STRIP]
                y = inputs[: len(part), : len(part)] @ part + remembered[: len(part)] @ state
                if not np.isfinite(y).all():
                    y = recursive_by_sample(part, a, state)
                out[at : at + STRIP] = y
                state = np.concatenate([y[::-1], state])[:order]
    return out, line[::-1][: len(b)].tolist(), state.tolist()


def recursive_by_sample(u: np.ndarray, a: list[float], state: np.ndarray) -> np.ndarray:
    """A strip of a filter that overflows: what is not finite becomes zero before it is fed back."""
    held, out = state.tolist(), []
    for value in u.tolist():
        y = value - sum(c * p for c, p in zip(a[1:], held))
        out.append(y if math.isfinite(y) else 0.0)
        held = [out[-1], *held[:-1]]
    return np.array(out)


def iir(samples: DataFrame, b, a, sample_type: str = "f64", block: int = BLOCK) -> DataFrame:
    """The difference equation with coefficients ``b`` over ``a``, from silence.

    1. each block runs from a silent past and reports its last outputs;
    2. the state at a block's end is those outputs plus a fixed matrix (the filter's own decay over a block)
       times the state at its start, so a short pass over blocks gives every block its state;
    3. each block runs again from that state.
    Blocks borrow the inputs that the equation looks back on.
    """
    b, a = check_coefficients(b, "b"), check_coefficients(a, "a")
    if a[0] == 0:
        raise InvalidData("the first coefficient of a must not be zero")
    b, a = [x / a[0] for x in b], [x / a[0] for x in a]
    zero = offset_of(sample_type)
    order, back = len(a) - 1, len(b) - 1
    block = max(block, order, back, 1)
    source = with_halo(samples.withColumn("v", finite(F.col("v") - zero)), back, block=block)
    keys = ["stream_id", "ch", "block_"]

    def run(pdf: pd.DataFrame, past: list[float]) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("n")
        own = pdf["own_"].to_numpy()
        x = pdf["v"].to_numpy()
        y, _, _ = recursive(x[own], b, a, x[~own][::-1].tolist(), past)
        return pdf[own], y

    def last_outputs(pdf: pd.DataFrame) -> pd.DataFrame:
        own, y = run(pdf, [0.0] * order)
        if not len(own):  # a block of borrowed samples only, beyond the channel's end
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("stream_id", "ch", "block_", "last")})
        last = y[::-1][:order].tolist()
        return pd.DataFrame({"stream_id": own["stream_id"].iloc[:1], "ch": own["ch"].iloc[:1], "block_": own["block_"].iloc[:1], "last": [last + [0.0] * (order - len(last))]})

    # the filter's decay over one whole block: a column for each remembered output
    decay = np.zeros((order, order))
    for j in range(order):
        past = [0.0] * order
        past[j] = 1.0
        _, _, end = recursive(np.zeros(block), [0.0], a, [], past)
        decay[:, j] = end[:order]

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_")
        state, out = np.zeros(order), []
        for last in pdf["last"]:
            out.append(state.tolist())
            state = np.array(last) + decay @ state
        return pd.DataFrame({"stream_id": pdf["stream_id"], "ch": pdf["ch"], "block_": pdf["block_"], "past": out})

    def outputs(key, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own, y = run(pdf, list(state["past"].iloc[0]) if len(state) else [0.0] * order)
        return pd.DataFrame({"stream_id": own["stream_id"], "ch": own["ch"], "n": own["n"], "v": y})

    if order:
        ends = source.groupBy(*keys).applyInPandas(last_outputs, "stream_id string, ch int, block_ bigint, last array<double>")
        # a row for each block of a channel
        begins = ends.groupBy("stream_id", "ch").applyInPandas(states, "stream_id string, ch int, block_ bigint, past array<double>")
        out = source.groupBy(*keys).cogroup(begins.groupBy(*keys)).applyInPandas(outputs, SCHEMA)
    else:
        out = source.groupBy(*keys).applyInPandas(lambda pdf: outputs(None, pdf, pd.DataFrame({"past": []})), SCHEMA)
    return out.withColumn("v", quantise(finite(F.col("v")) + zero, sample_type))


def iir_by_fold(samples: DataFrame, b, a) -> DataFrame:
    """The same for short streams, by folding an ordered array; at most two feedback coefficients."""
    b, a = check_coefficients(b, "b"), check_coefficients(a, "a")
    b, a = [x / a[0] for x in b], [x / a[0] for x in a]
    if len(a) > 3 or len(b) > 3:
        raise InvalidData("the fold holds two past values")
    b, a = b + [0.0] * (3 - len(b)), a + [0.0] * (3 - len(a))
    ordered = samples.groupBy("stream_id", "ch").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("s"))
    start = F.expr("named_struct('x1', 0D, 'x2', 0D, 'y1', 0D, 'y2', 0D, 'out', cast(array() as array<struct<n:bigint,v:double>>))")

    def step(s: Column, x: Column) -> Column:
        y = x["v"] * b[0] + s["x1"] * b[1] + s["x2"] * b[2] - s["y1"] * a[1] - s["y2"] * a[2]
        return F.struct(
            x["v"].alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"), F.concat(s["out"], F.array(F.struct(x["n"].alias("n"), y.alias("v")))).alias("out")
        )

    folded = ordered.select("stream_id", "ch", F.explode(F.aggregate("s", start, step, lambda s: s["out"])).alias("o"))
    return folded.select("stream_id", "ch", "o.n", "o.v")


def curve_of(level: np.ndarray, d: Dynamics, kind) -> np.ndarray:
    """Gains in decibels at levels, in the number type ``kind``."""
    t, w, slope = kind(d.threshold_db), kind(d.knee_width_db), kind(1) / kind(d.ratio) - kind(1)
    over = level - t
    out = np.where(over <= 0, kind(0), slope * over)
    if w > 0:
        into = level - t + w * kind(0.5)
        out = np.where(level < t - w * kind(0.5), kind(0), np.where(level > t + w * kind(0.5), slope * over, slope * (into * into) / (kind(2) * w)))
    if d.expansion_ratio > 1:
        low = kind(d.expansion_threshold_db)
        out = np.where(level < low, (kind(d.expansion_ratio) - kind(1)) * (level - low), out)
    return out


def follow(x: np.ndarray, d: Dynamics, start: float, kind) -> np.ndarray:
    """The envelope of absolute values: one weight when it rises, another when it falls."""
    up, down, one = kind(d.attack), kind(d.release), kind(1)
    env = kind(start)
    # numbers of Python are the same 64 bits and several times as fast as numpy's; 32 bits have none
    if kind is np.float64:
        up, down, one, env, values = float(up), float(down), 1.0, float(env), x.tolist()
    else:
        values = x
    out = []
    for value in values:
        c = up if value >= env else down
        env = c * env + (one - c) * value
        out.append(env)
    return np.array(out, kind)


def compress_values(v: np.ndarray, d: Dynamics, sample_type: str, precision: str, start: float = 0.0) -> tuple[np.ndarray, float]:
    """Raw values after the dynamics curve (not yet quantised), and the envelope at the end."""
    signal = np.float64 if precision == "f64" or sample_type in ("i64", "f64") else np.float32
    kind = np.float64 if precision == "f64" else np.float32
    scale, zero = FULL_SCALE.get(sample_type, 1.0), offset_of(sample_type)
    x = ((v - zero) / scale).astype(signal)
    x[~np.isfinite(x)] = 0
    env = follow(np.abs(x).astype(kind), d, start, kind)
    level = kind(20) * np.log10(np.maximum(env, kind(1e-12)))
    db = (curve_of(level, d, kind) + kind(d.master_gain_db)).astype(signal)
    y = x * np.power(signal(10), db * signal(0.05))
    return y.astype(np.float64) * scale + zero, float(env[-1]) if len(env) else start


def envelope_map(x: np.ndarray, up: float, down: float) -> tuple[list[float], list[float], float]:
    """The envelope after ``x`` as a function of the one before: knots, values there, and the slope beyond the last knot.

    A step maps envelopes up to the value by one affine function and those above by another, so the steps' composition is piecewise
    linear and rises. Values below all of the function, or above it, change it as a whole, which is kept as one affine function on top.
    """
    knots, values = np.zeros(1), np.zeros(1)
    scale, shift, slope = 1.0, 0.0, 1.0
    low = high = 0.0
    for value in x.tolist():
        if value < low:
            scale, shift, low, high = down * scale, down * shift + (1 - down) * value, down * low + (1 - down) * value, down * high + (1 - down) * value
        else:
            w = scale * values + shift
            i = int(np.searchsorted(w, value, side="right"))
            if w[i - 1] < value:  # the function passes the value between two knots, or beyond the last
                if i < len(w):
                    at = knots[i - 1] + (value - w[i - 1]) / (w[i] - w[i - 1]) * (knots[i] - knots[i - 1])
                else:
                    at = knots[-1] + (value - w[-1]) / slope if slope > 0 else math.inf
                if math.isfinite(at):
                    knots, w = np.insert(knots, i, at), np.insert(w, i, value)
                    i += 1
            values = np.concatenate([up * w[:i] + (1 - up) * value, down * w[i:] + (1 - down) * value])
            scale, shift, low, high = 1.0, 0.0, float(values[0]), float(values[-1])
        slope *= down
    return knots.tolist(), (scale * values + shift).tolist(), slope


def map_envelope(start: float, knots, values, slope: float) -> float:
    return float(np.interp(start, knots, values)) if start <= knots[-1] else float(values[-1] + slope * (start - knots[-1]))


def compressor(samples: DataFrame, dynamics: Dynamics, sample_type: str = "f64", precision: str = "exact", block: int = BLOCK) -> DataFrame:
    """Compression and expansion by a followed envelope.

    ``precision`` "exact" computes in 32 bits where streams are held so; "f64" computes all in 64 bits. Where an envelope fades to 1e-12
    of itself within a block, blocks borrow as many samples from the block before. Where it takes longer, every block says how its last
    envelope depends on its first, a pass over a channel's blocks (a row each) gives each block its first envelope, and the block runs from it.
    """
    slowest = max(dynamics.attack, dynamics.release)
    memory = math.ceil(math.log(1e-12) / math.log(slowest)) if 0 < slowest < 1 else 0 if slowest == 0 else block + 1
    kind = "f64" if precision == "f64" else "exact"

    def run(pdf: pd.DataFrame, start: float = 0.0) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        pdf["v"], _ = compress_values(pdf["v"].to_numpy(), dynamics, sample_type, kind, start)
        return pdf[pdf["own_"]][["stream_id", "ch", "n", "v"]]

    keys = ["stream_id", "ch", "block_"]
    if memory <= block:
        out = with_halo(samples, memory, block=block).groupBy(*keys).applyInPandas(lambda pdf: run(pdf), SCHEMA)
    else:
        source = with_halo(samples, 0, block=block)
        scale, zero = FULL_SCALE.get(sample_type, 1.0), offset_of(sample_type)

        def depends(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.abs((pdf.sort_values("n")["v"].to_numpy() - zero) / scale)
            knots, values, slope = envelope_map(np.where(np.isfinite(x), x, 0.0), dynamics.attack, dynamics.release)
            return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in keys}, "knots": [knots], "values": [values], "slope": [slope]})

        def starts(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block_")
            env, out = 0.0, []
            for knots, values, slope in zip(pdf["knots"], pdf["values"], pdf["slope"]):
                out.append(env)
                env = map_envelope(env, knots, values, slope)
            return pdf[keys].assign(start=out)

        maps = source.groupBy(*keys).applyInPandas(depends, "stream_id string, ch int, block_ bigint, knots array<double>, values array<double>, slope double")
        begins = maps.groupBy("stream_id", "ch").applyInPandas(starts, "stream_id string, ch int, block_ bigint, start double")
        out = source.groupBy(*keys).cogroup(begins.groupBy(*keys)).applyInPandas(lambda pdf, begin: run(pdf, float(begin["start"].iloc[0])), SCHEMA)
    return out.withColumn("v", quantise(finite(F.col("v")), sample_type))


@lru_cache(16)
def sinc_bank(rate_in: int, rate_out: int, zeros: int) -> tuple[int, int, int, np.ndarray]:
    """Steps up and down of the reduced rates, taps on either side, and the weights: a row a phase, whose weights add up to one.

    The weight at distance t (input samples) is sinc(c t) times a raised cosine over ``zeros`` crossings on either side, c being the narrower
    of the two bands over the input's.
    """
    shared = math.gcd(rate_in, rate_out)
    up, down = rate_out // shared, rate_in // shared
    c = min(1.0, up / down)
    side = math.ceil(zeros / c)
    t = np.arange(up)[:, None] / up - np.arange(1 - side, side + 1)[None, :]
    w = np.sinc(c * t) * np.where(np.abs(c * t) < zeros, 0.5 + 0.5 * np.cos(np.pi * c * t / zeros), 0.0)
    return up, down, side, w / w.sum(axis=1, keepdims=True)


def resample_band_limited(samples: DataFrame, rate_in: int, rate_out: int, zeros: int = 16, block: int = BLOCK) -> DataFrame:
    """Resampling of whole channels by a windowed-sinc filter bank, silence being around them; as long as ``resample`` makes it.

    Output k lies at k * rate_in / rate_out; it takes the ``zeros`` crossings on either side. Blocks of inputs borrow those of both
    neighbours that their outputs look at, so no block holds more than ``block`` and two filter lengths.
    """
    resampled_length(0, rate_in, rate_out)
    if zeros < 1:
        raise InvalidData("a filter has one crossing on either side at least")
    if rate_in == rate_out:
        return samples
    up, down, side, bank = sinc_bank(rate_in, rate_out, zeros)
    block = max(block, side)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own_"]]
        if not len(own):  # borrowed samples only, beyond the channel's end
            return pd.DataFrame({"stream_id": [], "ch": [], "n": [], "v": []})
        at, n = int(pdf["block_"].iloc[0]) * block, pdf["n"].to_numpy()
        line = np.zeros(block + 2 * side + 2)
        line[n - at + side] = np.where(np.isfinite(pdf["v"].to_numpy()), pdf["v"].to_numpy(), 0.0)
        last = int(own["n"].max())
        k = np.arange(-(-at * up // down), -(-(last + 1) * up // down))  # outputs whose place lies in the block
        if int(n.max()) == last:  # nothing borrowed from a next block, so the channel ends here
            k = k[k < resampled_length(last + 1, rate_in, rate_out)]
        place = k * down
        i, phase = place // up - at, place % up
        v = np.empty(len(k))
        for a in range(0, len(k), 4096):
            v[a : a + 4096] = np.einsum("kt,kt->k", line[i[a : a + 4096, None] + side + np.arange(1 - side, side + 1)], bank[phase[a : a + 4096]])
        return pd.DataFrame({"stream_id": own["stream_id"].iloc[0], "ch": own["ch"].iloc[0], "n": k, "v": v})

    return with_halo(samples, side, side, block).groupBy("stream_id", "ch", "block_").applyInPandas(make, SCHEMA)


def resample(samples: DataFrame, rate_in: int, rate_out: int, narrow: bool = False) -> DataFrame:
    """Linear interpolation of whole channels at positions k * rate_in / rate_out; the last sample is held.

    Each source sample makes the outputs that lie between it and its successor, so nothing is joined: the successor
    comes from a window over its block. ``narrow`` interpolates in 32 bits, as streams of 32-bit values do.
    """
    resampled_length(0, rate_in, rate_out)
    if rate_in == rate_out:
        return samples
    step = rate_in / rate_out
    # a block sees so far ahead that the channel's end, where it is near enough to bound the block's outputs, is in sight
    ahead = math.ceil(1.5 * step) + 1
    block = ["stream_id", "ch", "block_"]
    s = with_halo(samples, 0, ahead).withColumn("next_", F.lead("v").over(Window.partitionBy(*block).orderBy("n")))
    s = s.withColumn("len_", F.max("n").over(Window.partitionBy(*block)) + 1).where("own_").drop("block_", "own_")
    n_out = F.when(F.col("len_") < 2, F.col("len_")).otherwise(F.greatest(F.lit(1), F.expr(f"(len_ * {rate_out} + {rate_in // 2}) div {rate_in}")))
    s = s.withColumn("m_", n_out)
    last = F.col("n") == F.col("len_") - 1
    # candidates one wider on both sides, then the exact test on floor(k * step)
    low = F.greatest(F.floor(F.col("n") / step) - 1, F.lit(0))
    high = F.when(last, F.col("m_") - 1).otherwise(F.least(F.ceil((F.col("n") + 1) / step) + 1, F.col("m_") - 1))
    k = s.select("stream_id", "ch", "n", "v", "next_", last.alias("last_"), F.explode(F.when(high >= low, F.sequence(low, high))).alias("k"))
    at = F.col("k") * F.lit(step)
    whole = F.floor(at)
    t = at - whole
    kept = F.when(F.col("last_"), whole >= F.col("n")).otherwise(whole == F.col("n"))
    a, b = F.col("v"), F.col("next_")
    if narrow:
        a, b, t = a.cast("float"), b.cast("float"), t.cast("float")
    value = F.when(F.col("last_"), F.col("v")).otherwise((a + (b - a) * t).cast("double"))
    return k.where(kept).select("stream_id", "ch", F.col("k").cast("bigint").alias("n"), value.alias("v"))


def resample_frames(samples: DataFrame, fmt: AudioFormat, rate_out: int, size: int, pad_final: bool = True, method: str = "linear") -> DataFrame:
    """Frames of exactly ``size`` samples of all channels of ``fmt`` at another rate; the rest is padded with zeros, or dropped."""
    if method not in ("linear", "band_limited"):
        raise InvalidData(f"no resampling method {method!r}")
    narrow = fmt.sample_type in ("f32", "i16", "i32")
    out = resample(samples, fmt.sample_rate, rate_out, narrow) if method == "linear" else resample_band_limited(samples, fmt.sample_rate, rate_out)
    out = out.withColumn("v", quantise(F.col("v"), fmt.sample_type))
    return samples_to_frames(out, replace(fmt, sample_rate=rate_out), size, "pad" if pad_final else "drop")


def convert(samples: DataFrame, type_in: str, type_out: str) -> DataFrame:
    """Values of another sample type, by the normalised domain."""
    from tidewell.functions.levels import denormalise, normalise

    return samples.withColumn("v", denormalise(normalise(F.col("v"), type_in), type_out))


def interleave(samples: DataFrame, channels: int) -> DataFrame:
    """stream_id, i, v: channels in turn at each position."""
    return samples.select("stream_id", (F.col("n") * channels + F.col("ch")).alias("i"), "v")


def deinterleave(flat: DataFrame, channels: int) -> DataFrame:
    return flat.select("stream_id", (F.col("i") % channels).cast("int").alias("ch"), F.expr(f"i div {channels}").alias("n"), "v")


def mix_channels(samples: DataFrame, channels_in: int, channels_out: int) -> DataFrame:
    """Another number of channels: one is copied to all, all are averaged to one; further channels are dropped or silent."""
    if channels_in == channels_out:
        return samples
    if channels_out == 1:
        return samples.groupBy("stream_id", "n").agg(F.avg("v").alias("v")).select("stream_id", F.lit(0).alias("ch"), "n", "v")
    if channels_in == 1:
        return samples.select("stream_id", F.explode(F.sequence(F.lit(0), F.lit(channels_out - 1))).alias("ch"), "n", "v")
    kept = samples.where(F.col("ch") < channels_out)
    if channels_out <= channels_in:
        return kept
    silent = samples.where("ch = 0").select("stream_id", F.explode(F.sequence(F.lit(channels_in), F.lit(channels_out - 1))).alias("ch"), "n", F.lit(0.0).alias("v"))
    return kept.unionByName(silent)
