"""Properties of the small kernels, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.functions.levels import Dynamics
from tidewell.model import AudioFormat
from tidewell.operators import codecs, processors
from tidewell.sources import containers

LIMITS = {"u8": (0, 255), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1)}
few = settings(max_examples=60, deadline=None)


@few
@given(st.sampled_from(sorted(LIMITS)), st.integers(1, 4), st.data())
def test_pcm_bytes_round_trip(kind, channels, data):
    low, high = LIMITS[kind]
    n = data.draw(st.integers(0, 20))
    planes = [data.draw(st.lists(st.integers(low, high), min_size=n, max_size=n)) for _ in range(channels)]
    fmt = AudioFormat(8000, channels, kind, planar=False)
    raw = codecs.to_bytes(planes, fmt)
    assert len(raw) == channels * n * fmt.bytes_per_sample
    assert codecs.from_bytes(raw, fmt) == [[float(v) for v in p] for p in planes]


@few
@given(st.lists(st.floats(-1.5, 1.5, width=32), max_size=50), st.integers(1, 3))
def test_wav_float_files_round_trip(values, channels):
    planes = [np.array(values, np.float32) + np.float32(0) for _ in range(channels)]
    data = containers.wav_file(planes, 8000, "f32le")
    wav = containers.wav_header(data)
    assert wav.length // wav.frame_bytes == len(values)
    assert np.array_equal(containers.wav_samples(data, wav, 0, len(values)), np.array(planes, np.float32).reshape(channels, -1))


@few
@given(st.lists(st.floats(-10, 10), min_size=1, max_size=60), st.lists(st.floats(-1, 1), min_size=1, max_size=4), st.lists(st.floats(-0.4, 0.4), max_size=3), st.integers(1, 59))
def test_recursive_filter_goes_on_from_its_memory(x, b, tail, cut):
    a = [1.0, *tail]
    x = np.array(x)
    whole, _, _ = processors.recursive(x, b, a, [], [0.0] * len(tail))
    first, px, py = processors.recursive(x[:cut], b, a, [], [0.0] * len(tail))
    second, _, _ = processors.recursive(x[cut:], b, a, px[: len(b) - 1], py)
    assert np.allclose(np.concatenate([first, second]), whole, atol=1e-9)


@few
@given(st.lists(st.floats(-1, 1), min_size=2, max_size=60), st.integers(1, 59))
def test_compressor_goes_on_from_its_envelope(x, cut):
    d = Dynamics(1000, attack_time=0.002, release_time=0.01)
    x = np.array(x)
    whole, _ = processors.compress_values(x, d, "f64", "f64")
    first, env = processors.compress_values(x[:cut], d, "f64", "f64")
    second, _ = processors.compress_values(x[cut:], d, "f64", "f64", env)
    assert np.allclose(np.concatenate([first, second]), whole, atol=1e-12)


@few
@given(st.lists(st.binary(max_size=600), min_size=1, max_size=5))
def test_ogg_packets_round_trip(packets):
    data = containers.ogg_file([(p, i) for i, p in enumerate(packets)], [b"head", b"tags"])
    assert [p for p, _ in containers.ogg_packets(data)] == [b"head", b"tags", *packets]


@few
@given(st.binary(max_size=300))
def test_readers_take_any_bytes(data):
    list(containers.adts_packets(data))
    list(containers.mp3_packets(data))
    list(containers.ogg_packets(data))
    containers.length_prefixed(data)
    assert 0 <= containers.id3_size(data) <= len(data)
