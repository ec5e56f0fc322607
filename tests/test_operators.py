import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import headers, levels
from tidewell.model import AudioFormat, InvalidData, Rational, Unsupported, delay_samples, rescale_pts, resampled_length
from tidewell.operators import codecs, forkjoin, framing, processors
from tidewell.plans import pipeline
from tidewell.sources import containers, files


def signal(spark, channels):
    rows = [(f"s{i}", 0, n, float(v)) for i, ch in enumerate(channels) for n, v in enumerate(ch)]
    return spark.createDataFrame(rows, "stream_id string, ch int, n bigint, v double").repartition(4)


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stream_id, {})[r.n] = r.v
    return {k: [v[n] for n in sorted(v)] for k, v in out.items()}


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_gain_of_each_type(spark):
    nan, inf = float("nan"), float("inf")
    s = signal(spark, [[-32768, -3, 5, 32767]])
    assert values(processors.gain(s, 0.5, "i16"))["s0"] == [-16384, -2, 3, 16384]
    assert values(processors.gain(s, 2.0, "i16"))["s0"] == [-32768, -6, 10, 32767]
    assert values(processors.gain(signal(spark, [[0, 127, 128, 255]]), 2.0, "u8"))["s0"] == [0, 126, 128, 255]
    assert values(processors.gain(signal(spark, [[nan, inf, -inf, 1]]), -1.0))["s0"] == [0, -inf, inf, -1]
    assert column(spark, levels.to_integer(F.lit(1e300), "i64")) == 2**63 - 1
    with pytest.raises(InvalidData):
        processors.gain(s, nan)


def test_fir_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    s = signal(spark, [x, x[:1]])
    for taps in ([1.0], [0.2, -0.5, 0.1], [0.25] * 8, rng.normal(size=100).tolist()):
        want = np.convolve(x, np.array(taps, np.float32).astype(float))[:300]
        for block in (1, 64, 1000):
            got = values(processors.fir(s, taps, block=block))
            assert np.allclose(got["s0"], want, atol=1e-9) and len(got["s1"]) == 1
    impulse = values(processors.fir(signal(spark, [[1.0] + [0.0] * 5]), [0.3, 0.2]))["s0"]
    assert impulse == [float(np.float32(0.3)), float(np.float32(0.2)), 0, 0, 0, 0]


@pytest.mark.parametrize("n,taps,block", [(500, 300, 64), (100, 64, 16), (10, 200, 64), (3_000, 100_000, 4_096)])
def test_more_taps_than_a_block_holds(spark, n, taps, block):
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=n), rng.normal(size=taps) / taps
    got = values(processors.fir(signal(spark, [x, [1.0]]), h, block=block))
    assert np.allclose(got["s0"], np.convolve(x, h.astype(np.float32).astype(float))[:n], atol=1e-9) and len(got["s0"]) == n
    assert np.allclose(got["s1"], [h[0].astype(np.float32)])


def test_iir_equals_its_recurrence_for_any_block(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=257)
    s = signal(spark, [x])
    for b, a in (([0.1], [1.0, -0.9]), ([0.5, 1.0, 0.5], [2.0, -1.5, 0.5]), ([1.0, 0.5], [1.0])):
        want, y = [], []
        for n in range(len(x)):
            v = sum(c * x[n - k] for k, c in enumerate(np.array(b, np.float32) / a[0]) if n >= k)
            v -= sum(c * y[n - k] for k, c in enumerate(np.array(a, np.float32) / a[0]) if k and n >= k)
            y.append(v)
            want.append(v)
        for block in (3, 50, 1000):
            assert np.allclose(values(processors.iir(s, b, a, block=block))["s0"], want, atol=1e-9)
    short = signal(spark, [x[:40]])
    assert np.allclose(values(processors.iir_by_fold(short, [0.1], [1.0, -0.9]))["s0"], values(processors.iir(short, [0.1], [1.0, -0.9]))["s0"])


def test_compressor_curve_and_envelope(spark):
    d = levels.Dynamics(1000, threshold_db=-20, knee_width_db=0, ratio=4, expansion_ratio=1, attack_time=0, release_time=0)
    got = values(processors.compressor(signal(spark, [[0.01, 1.0, -0.5]]), d))["s0"]
    want = [0.01, 10 ** (-15 / 20), -0.5 * 10 ** (-0.75 * (20 * math.log10(0.5) + 20) / 20)]
    assert np.allclose(got, want, rtol=1e-5)
    slow = levels.Dynamics(1000, attack_time=0.002, release_time=0.004)
    x = np.random.default_rng(2).uniform(-1, 1, 900)
    whole = processors.compress_values(x, slow, "f64", "f64")[0]
    for block in (64, 5000):
        assert np.allclose(values(processors.compressor(signal(spark, [x]), slow, precision="f64", block=block))["s0"], whole, atol=1e-10)
    for level in np.linspace(-90, 0, 40):
        assert math.isclose(column(spark, levels.curve_db(F.lit(float(level)), slow)), float(processors.curve_of(np.array([level]), slow, np.float64)[0]), abs_tol=1e-9)
    with pytest.raises(InvalidData):
        levels.Dynamics(48000, ratio=0.5)


@pytest.mark.parametrize("attack,release", [(0.002, 8.0), (5.0, 0.01), (0.0, 9.0), (3.0, 3.0)])
def test_envelopes_longer_than_blocks_are_exact(spark, attack, release):
    rng = np.random.default_rng(5)
    d = levels.Dynamics(1000, attack_time=attack, release_time=release)
    x = rng.normal(size=700) * np.repeat(rng.choice([0.0, 0.01, 1.0, 3.0], 70), 10)
    want, _ = processors.compress_values(x.copy(), d, "f64", "f64")
    got = values(processors.compressor(signal(spark, [x]), d, precision="f64", block=64))["s0"]
    assert np.allclose(got, want, rtol=1e-11, atol=1e-14)
    for start in (0.0, 0.3, 0.9, 40.0):
        knots, heights, slope = processors.envelope_map(np.abs(x[:90]), d.attack, d.release)
        env = processors.follow(np.abs(x[:90]), d, start, np.float64)[-1]
        assert math.isclose(processors.map_envelope(start, knots, heights, slope), env, rel_tol=1e-12, abs_tol=1e-15)


@pytest.mark.parametrize("rate_in,rate_out", [(44100, 48000), (48000, 44100), (1, 2), (7, 3), (5, 5)])
def test_band_limited_resampling(spark, rate_in, rate_out):
    n = np.arange(900)
    tone = np.sin(0.05 * n)
    got = values(processors.resample_band_limited(signal(spark, [tone, [2.0]]), rate_in, rate_out, block=200))
    assert len(got["s0"]) == resampled_length(900, rate_in, rate_out) and len(got["s1"]) == 1
    k = np.arange(len(got["s0"])) * rate_in / rate_out
    inner = (k > 120) & (k < 780)
    assert np.abs(np.array(got["s0"]) - np.sin(0.05 * k))[inner].max() < 2e-3
    whole = values(processors.resample_band_limited(signal(spark, [tone]), rate_in, rate_out))
    assert np.allclose(whole["s0"], got["s0"], atol=1e-12)
    high = values(processors.resample_band_limited(signal(spark, [np.sin(3.0 * n)]), 3, 1))["s0"]  # beyond the new band
    assert np.abs(high[60:240]).max() < 5e-3


def test_resample_lengths_ramps_and_tail(spark):
    for n, a, b in ((0, 1, 2), (1, 1, 2), (2, 1, 2), (100, 44100, 48000), (100, 2, 1), (100, 1, 2), (100, 3, 2)):
        got = values(processors.resample(signal(spark, [list(range(n)), [7.0, 7.0]]), a, b)).get("s0", [])
        assert len(got) == resampled_length(n, a, b)
        for k, v in enumerate(got):
            at = k * (a / b)
            assert math.isclose(v, min(at, n - 1), abs_tol=1e-9)


def test_delay_and_its_frames(spark):
    assert values(processors.delay(signal(spark, [[1, 2]]), 3, 1000))["s0"] == [0, 0, 0, 1, 2]
    assert values(processors.delay(signal(spark, [[1, 2]]), 1, 1000, "u8"))["s0"] == [128, 1, 2]
    frames = spark.createDataFrame([("a", 0, 0, 100), ("a", 1, 100, 50)], "stream_id string, seq bigint, pts bigint, nb_samples int")
    got = sorted(tuple(r) for r in processors.delay_frames(frames, 10, 1000).collect())
    assert got == [("a", 0, -10, 100), ("a", 1, 90, 50), ("a", 2, 140, 10)]
    assert delay_samples(0.5, 1000) == 1


def test_windows_and_tails(spark):
    for n in (0, 1, 3, 4, 5, 17):
        s = signal(spark, [list(range(n)), [0.0]])
        sizes = {t: sorted(len(r["values"]) for r in framing.rechunk(s, 4, t).where("stream_id = 's0'").collect()) for t in ("emit", "drop", "pad")}
        assert sizes["drop"] == [4] * (n // 4) and sizes["pad"] == [4] * -(-n // 4)
        assert sorted(sizes["emit"]) == sorted([4] * (n // 4) + ([n % 4] if n % 4 else []))


def test_time_stamps_after_a_break(spark):
    frames = [("a", 0, 0, 6), ("a", 1, 7, 6), ("a", 2, 13, 8), ("a", 3, 100, 10), ("a", 4, None, 10)]
    df = spark.createDataFrame(frames, "stream_id string, seq bigint, pts bigint, nb_samples int")
    assert [r.continues for r in framing.pts_breaks(df).orderBy("seq").collect()] == [True, False, True, False, False]
    assert [(r.chunk, r.pts) for r in framing.chunk_pts(df, 10).orderBy("chunk").collect()] == [(0, None), (1, None), (2, 100), (3, None)]
    for pts, a, b in ((-7, Rational(1, 2), Rational(1, 1)), (10**15, Rational(1, 44100), Rational(1, 90000)), (2**62, Rational(1, 1), Rational(1, 1000)), (1, Rational(1, 0), Rational(1, 1))):
        want = None
        if a.den and b.den:
            q = abs(pts * a.num * b.den) // abs(a.den * b.num) * (1 if pts >= 0 else -1)
            want = q if abs(q) < 2**63 else None
        assert column(spark, rescale_pts(F.lit(pts).cast("bigint"), a, b)) == want


def test_window_time_stamps_equal_a_buffer(spark, monkeypatch):
    """Frames pushed one by one into a buffer, in streams of several runs."""
    monkeypatch.setattr(framing, "RUN", 5)
    rnd = random.Random(6)
    frames, want = [], {}
    for s in range(30):
        base, held, popped, at = None, 0, 0, 0
        for seq in range(rnd.randrange(1, 30)):
            n, pts = rnd.choice([4, 8, 8, 12, 3]), rnd.choice([at, at, at, at + 5, at + 5, None])
            frames.append((str(s), seq, pts, n))
            if base is None and not held:
                base = pts
            elif base is not None and base + held != pts:
                base = None
            held, at = held + n, at + n
            while held >= 8:
                want[str(s), popped] = base
                held, popped, base = held - 8, popped + 1, None if base is None else base + 8
    df = spark.createDataFrame(frames, "stream_id string, seq bigint, pts bigint, nb_samples int").repartition(5)
    assert {(r.stream_id, r.chunk): r.pts for r in framing.chunk_pts(df, 8).collect()} == want
    assert sum(v is not None for v in want.values()) > 50


def test_reducers(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    nan = float("nan")
    assert column(spark, forkjoin.total()(lit(1, 2, 3))) == 6
    assert column(spark, forkjoin.total([2, 3, 4])(lit(1, 2, 3))) == 20
    assert column(spark, forkjoin.product([2, 3, 4])(lit(1, 2, 3))) == 144
    assert column(spark, forkjoin.mean_whole()(lit(1, 2, 3, 4))) == 2 and column(spark, forkjoin.mean_whole()(lit(-1, -2))) == -1
    assert column(spark, forkjoin.highest()(lit(1.0, nan, 3.0))) == 3.0 and column(spark, forkjoin.lowest()(lit(nan))) == math.inf
    assert column(spark, forkjoin.joined_text()(lit("ab", "-", "cd"))) == "ab-cd"
    assert column(spark, forkjoin.exclusive_or()(lit(0b1100, 0b1010))) == 0b0110
    with pytest.raises(InvalidData):
        forkjoin.total([1])(lit(1, 2))
    with pytest.raises(InvalidData):
        forkjoin.total()([])


def test_branches_drop_what_others_lack(spark):
    s = signal(spark, [[1, 2, 3, 4]])
    got = forkjoin.mix(s, [lambda d: d, lambda d: d.where("n < 2")], forkjoin.total())
    assert values(got)["s0"] == [2, 4]
    assert values(forkjoin.concat_streams([s, s.where("n < 1")]))["s0"] == [1, 2, 3, 4, 1]


def test_pointwise_branches_need_no_exchange(spark):
    s = signal(spark, [[1, 2, 3]])
    factors = (0.5, -2.0)
    pointwise = [forkjoin.Pointwise(lambda v, g=g: processors.gained(v, g, "f64")) for g in factors]
    plain = [lambda d, g=g: processors.gain(d, g) for g in factors]
    one, other = (forkjoin.mix(s, b, forkjoin.total([1.0, 0.25])) for b in (pointwise, plain))
    assert values(one) == values(other)
    joins = [d._jdf.queryExecution().optimizedPlan().toString() for d in (one, other)]
    assert "Aggregate" not in joins[0] and "Aggregate" in joins[1]


def test_pcm_codec_and_wav_files(spark, tmp_path):
    fmt = AudioFormat(8000, 2, "i16", planar=False)
    rows = [("a", c, n, float((-1) ** c * (n * 3000 - 20000))) for c in range(2) for n in range(13)]
    s = spark.createDataFrame(rows, "stream_id string, ch int, n bigint, v double")
    frames = framing.samples_to_frames(s, fmt, 5)
    back = framing.frames_to_samples(codecs.decode_pcm(codecs.encode_pcm(frames, fmt), fmt))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    unit = framing.samples_to_frames(processors.convert(s, "i16", "f64"), AudioFormat(8000, 2, "f64"), 5)
    for encoding, tolerance in (("pcm16le", 2 / 32768), ("f32le", 1e-7)):
        folder = str(tmp_path / encoding)
        written = files.write_files(unit, folder, encoding=encoding).collect()
        assert len(written) == 1
        read = files.read_wav(spark, folder, 4)
        assert [r.nb_samples for r in read.orderBy("seq").collect()] == [4, 4, 4, 1] and read.first().pts is not None
        got = {(r.ch, r.n): r.v for r in framing.frames_to_samples(read).collect()}
        assert all(abs(got[c, n] - v / 32768) <= tolerance for _, c, n, v in rows)
    spark.dataSource.register(files.WavSource)
    assert spark.read.format("tidewell-wav").option("chunk_samples", "4").load(f"{tmp_path}/f32le/*.wav").count() == 4
    with pytest.raises(InvalidData):
        codecs.from_bytes(b"123", fmt)
    assert containers.wav_file([np.array([-1.0, 1.0, 2.0])], 8000)[44:] == np.array([-32767, 32767, 32767], "<i2").tobytes()


def test_files_of_many_frames_come_in_parts(spark, tmp_path):
    n = files.ROWS + 3
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wav").write_bytes(containers.wav_file([np.linspace(-1, 1, 2 * n - 1)], 8000, "f32le"))
    (tmp_path / "w" / "b.wav").write_bytes(containers.wav_file([np.zeros(0)], 8000, "f32le"))
    got = files.read_wav(spark, str(tmp_path / "w"), 2).orderBy("seq").collect()
    assert [(r.seq, r.pts, r.nb_samples) for r in got] == [(i, 2 * i, 2) for i in range(n - 1)] + [(n - 1, 2 * n - 2, 1)]
    packets = spark.createDataFrame([("s", i, b"%d" % i) for i in range(n)], "stream_id string, seq bigint, data binary")
    files.write_audio(packets, str(tmp_path / "p"), "aac", AudioFormat(48000, 2)).collect()
    read = files.read_adts(spark, str(tmp_path / "p")).orderBy("seq").collect()
    assert [(r.seq, bytes(r.data), r.pts) for r in read] == [(i, b"%d" % i, 1024 * i) for i in range(n)]


def test_wav_headers_with_other_chunks():
    data = containers.wav_file([np.zeros(3)], 8000)
    odd = data[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\x00" + data[12:]
    assert containers.wav_header(odd).length == 6
    with pytest.raises(InvalidData):
        containers.wav_header(b"RIFF....WAVE")


def test_packet_containers(spark, tmp_path):
    payload = [b"a" * 20, b"b" * 300]
    head = column(spark, F.concat(*[F.concat(headers.build_adts(F.lit(2), F.lit(4), F.lit(2), F.lit(len(p))), F.lit(p)) for p in payload]))
    assert [(d, rate, pts) for d, rate, pts, _ in containers.adts_packets(b"junk" + bytes(head))] == [(payload[0], 44100, 0), (payload[1], 44100, 1024)]
    read = column(spark, headers.read_adts(F.lit(bytes(head))))
    assert (read.sample_rate, read.channels, read.profile, read.frame_length) == (44100, 2, 1, 27)
    assert bytes(column(spark, headers.build_asc(F.lit(1), F.lit(4), F.lit(2)))) == bytes([0x12, 0x10])
    assert headers.opus_head(2, 48000) == b"OpusHead\x01\x02\x00\x00\x80\xbb\x00\x00\x00\x00\x00"
    tag = b"ID3\x04\x00\x00\x00\x00\x01\x02" + bytes(200)
    assert column(spark, headers.id3_length(F.lit(tag))) == containers.id3_size(tag) == 140
    packets = spark.createDataFrame([("s", i, p, 960) for i, p in enumerate(payload)], "stream_id string, seq bigint, data binary, duration bigint")
    records = packets.select("stream_id", "seq", headers.packet_file_record(F.col("data"), F.col("duration")).alias("data"))
    blob = files.packet_blobs(records, headers.packet_file_header(Rational(1, 48000), b"xyz"))
    assert containers.packet_file(bytes(blob.first().content)) == (1, 48000, b"xyz", [(p, 960) for p in payload])
    files.write_blobs(blob, str(tmp_path / "p"), "pkt").collect()
    assert [(bytes(r.data), r.pts) for r in files.read_packet_file(spark, str(tmp_path / "p")).orderBy("seq").collect()] == [(payload[0], 0), (payload[1], 960)]
    assert containers.length_prefixed(b"\0\0\0\2hi\0\0\0\0zz") == [b"hi"]
    page = b"OggS" + bytes([0, 2]) + (7).to_bytes(8, "little") + b"abcd" + bytes(8) + bytes([3, 255, 1, 2]) + b"x" * 256 + b"yy"
    assert list(containers.ogg_packets(page)) == [(b"x" * 256, 7), (b"yy", 7)]
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    assert [(len(d), rate, n) for d, rate, n in containers.mp3_packets(tag[:140] + frame * 2)] == [(417, 44100, 1152)] * 2


def test_encoded_files_are_read_back(spark, tmp_path):
    payload = [b"a" * 20, b"b" * 700]
    packets = spark.createDataFrame([("s", i, p, 960) for i, p in enumerate(payload)], "stream_id string, seq bigint, data binary, duration bigint")
    fmt = AudioFormat(48000, 2)
    for kind, reader in (("aac", files.read_adts), ("opus", files.read_ogg)):
        files.write_audio(packets, str(tmp_path / kind), kind, fmt).collect()
        got = reader(spark, str(tmp_path / kind)).orderBy("seq").collect()
        assert [bytes(r.data) for r in got] == payload and got[0].time_base.den == 48000
    assert containers.ogg_crc(b"OggS") == 0x5FB0A94F
    with pytest.raises(Unsupported):
        files.write_audio(packets, str(tmp_path / "x"), "flac", fmt)
    unit = codecs.decode_pcm_unit(spark.createDataFrame([("s", 0, b"\x00\x80\xff\x7f", 0)], "stream_id string, seq bigint, data binary, pts bigint").withColumn("time_base", F.struct(F.lit(1).alias("num"), F.lit(8000).alias("den"))), AudioFormat(8000, 1, "i16", planar=False))
    assert [round(x, 4) for x in unit.first().samples[0]] == [-1.0, 1.0]


def test_transcoding_by_ending(spark, tmp_path, monkeypatch):
    from tidewell import __main__ as command

    (tmp_path / "in").mkdir()
    x = np.linspace(-1, 1, 3001)
    for i in range(2):
        (tmp_path / "in" / f"{i}.wav").write_bytes(containers.wav_file([x, -x], 8000, "f32le"))
    with pytest.raises(Unsupported):
        command.transcode(spark, f"{tmp_path}/in/*.wav", f"{tmp_path}/out.aac")
    with pytest.raises(InvalidData):
        command.kind_of("a.txt")
    monkeypatch.setitem(codecs._registered, "aac", codecs.Codec(codecs.encode_pcm, lambda p, f: codecs.decode_pcm(p, replace(f, planar=False))))  # a stand-in
    monkeypatch.setitem(codecs.FRAME_SAMPLES, "aac", 500)
    assert command.transcode(spark, f"{tmp_path}/in/*.wav", f"{tmp_path}/out.aac").count() == 2
    assert command.main([f"{tmp_path}/out.aac/*.aac", f"{tmp_path}/back", "--encoding", "f32le", "--decoded", "8000,2,f32", "--rate", "16000"]) == 0
    back = framing.frames_to_samples(files.read_wav(spark, f"{tmp_path}/back"))
    assert back.count() == 2 * 2 * 6002
    near = back.where("ch = 0 and n < 6000").withColumn("d", F.abs(F.col("v") - (-1 + F.col("n") / 3000))).agg(F.max("d")).first()[0]
    assert near < 1e-6


def test_encoders_keep_back_and_formats_are_checked(spark):
    fmt = AudioFormat(8000, 1, "i16", planar=False)
    s = signal(spark, [range(10), range(8), []])
    assert sorted((r.stream_id, r.duration) for r in codecs.encode(s, "wav", fmt, 4).collect()) == [("s0", 2), ("s0", 4), ("s0", 4), ("s1", 4), ("s1", 4)]
    whole = codecs.encode(s, "wav", fmt, 4, force=False)
    assert sorted((r.stream_id, r.duration) for r in whole.collect()) == [("s0", 4), ("s0", 4), ("s1", 4), ("s1", 4)]
    told = lambda taken: {r.stream_id: (r.pending_samples, r.state) for r in codecs.pending(s, "wav", 4, taken).collect()}
    assert told(0) == {"s0": (10, "ready"), "s1": (8, "ready")} and told(1) == {"s0": (6, "ready"), "s1": (4, "ready")}
    assert told(9) == {"s0": (2, "need_more"), "s1": (0, "empty")}
    assert [r.nb_samples for r in codecs.decode(whole, "wav", fmt, 3, force=False).where("stream_id = 's0'").collect()] == [3, 3]
    turns = codecs.Codec(codecs.encode_pcm, lambda p, f: codecs.decode_pcm(p, f).withColumn("format", F.when(F.col("seq") > 0, AudioFormat(9000, 1).column()).otherwise(F.col("format"))))
    codecs.register("flac", turns)
    try:
        with pytest.raises(Exception, match="differ"):
            codecs.decode(whole, "flac", fmt).collect()
    finally:
        del codecs._registered["flac"]


def test_resampled_frames_hold_all_channels(spark):
    s = spark.createDataFrame([("s", c, n, float(n * (c + 1))) for c in range(3) for n in range(10)], "stream_id string, ch int, n bigint, v double")
    fmt = AudioFormat(1000, 3, "f32")
    for pad, sizes in ((True, [8, 8, 8]), (False, [8, 8])):
        frames = pipeline.Pipeline([pipeline.resampler(fmt, 2000, 8, pad)])(s).orderBy("seq").collect()
        assert [r.nb_samples for r in frames] == sizes and {len(r.samples) for r in frames} == {3}
        assert frames[1].samples[2] == [3 * min(9.0, k / 2) for k in range(8, 16)] and frames[1].format.sample_rate == 2000
    one = processors.resample(s, 1000, 2000)
    windows = pipeline.processor("resample", rate_in=1000, rate_out=2000, out_chunk_samples=8)(s)
    assert windows.count() == 72 and windows.where("n < 20").exceptAll(one.select("stream_id", "ch", "n", "v")).count() == 0


def test_packet_reducers(spark):
    base = F.struct(F.lit(1).alias("num"), F.lit(1).alias("den"))
    p = spark.createDataFrame([(0, 0, b"\x0c\x01"), (0, 1, b"\x0a\x01")], "k int, branch int, data binary").withColumn("time_base", base)
    assert bytes(forkjoin.xor_packets(p, ["k"]).first().data) == b"\x06\x00"
    assert bytes(forkjoin.concat_packets(p, ["k"]).first().data) == b"\x0c\x01\x0a\x01"


def test_pipelines_are_checked_when_built(spark):
    fmt = AudioFormat(48000, 1, "i16", planar=False)
    with pytest.raises(InvalidData):
        pipeline.Pipeline([])
    with pytest.raises(InvalidData):
        pipeline.Pipeline([pipeline.encoder("wav", fmt), pipeline.processor("gain", gain=2.0)])
    with pytest.raises(Unsupported):
        pipeline.encoder("mp3", fmt)
    with pytest.raises(InvalidData):
        codecs.encode(signal(spark, [[1]]), "vorbis", fmt)
    kept = []
    p = pipeline.Pipeline(
        [
            pipeline.identity(),
            pipeline.processor("gain", gain=2.0, sample_type="i16"),
            pipeline.tap(lambda d: kept.append(d.count())),
            pipeline.encoder("wav", fmt, 4),
            pipeline.decoder("pcm", fmt),
            pipeline.fork_join([pipeline.Pipeline([pipeline.identity()]), pipeline.Pipeline([pipeline.processor("gain", gain=-1.0)])], forkjoin.total()),
        ]
    )
    got = []
    p.run(signal(spark, [[1, 2, 3, 4, 5]]), lambda d: got.append(values(d)))
    assert got[0]["s0"] == [0] * 5 and kept == [5]
    errors = []
    with pytest.raises(ZeroDivisionError):
        files.fan_out(signal(spark, [[1]]), [lambda d: 1 / 0, lambda d: errors.append(d.count())])
    assert errors == [1]


def test_formats_and_streams(spark):
    a, b = AudioFormat(48000, 2), AudioFormat(44100, 2, "i16")
    assert a.channel_layout_mask == 3 and "sample_rate: expected 48000, got 44100" in a.difference(b) and a.plane_bytes(10) == 40
    s = files.sine(spark, 0.1)
    assert s.count() == 8820 and abs(s.where("n = 25").first().v - 0.2 * math.sin(2 * math.pi * 440 * 25 / 44100)) < 1e-12
    frames = framing.samples_to_frames(s, AudioFormat(44100, 2, "f32"), 1024)
    assert frames.count() == 5
    mixed = frames.withColumn("format", F.when(F.col("seq") == 1, b.column()).otherwise(F.col("format")))
    from tidewell.model import check_one_format

    assert check_one_format(frames).count() == 5
    with pytest.raises(Exception, match="differ"):
        check_one_format(mixed).collect()
    joined = framing.prepend(frames.where("seq = 0"), frames.where("seq > 0").withColumn("seq", F.col("seq") - 1))
    assert sorted(r.seq for r in joined.collect()) == list(range(5))
    numbered = framing.number_rows(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], ["id"], F.col("id"))
    assert all(r.n == r.id // 3 for r in numbered.collect())
    stereo = processors.mix_channels(signal(spark, [[1, 2]]), 1, 2)
    assert stereo.count() == 4 and values(processors.mix_channels(stereo, 2, 1))["s0"] == [1, 2]


def test_short_parts_of_a_filter_share_blocks(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=500)
    table = spark.createDataFrame([("s", 0, n, float(v)) for n, v in enumerate(x)], "stream_id string, ch int, n bigint, v double")
    h = np.array(processors.check_coefficients([1 / (k + 1) for k in range(40)], "taps"))
    for block in (64, 1 << 14):
        monkeypatch.setattr(processors, "PART_SAMPLES", block)
        got = {r.n: r.v for r in processors.fir(table, h, block=16).collect()}
        assert len(got) == 500 and np.allclose([got[n] for n in range(500)], np.convolve(x, h)[:500], atol=1e-9)
    blocks = []
    monkeypatch.setattr(processors, "with_halo", lambda *a, **k: blocks.append(k["block"]) or framing.with_halo(*a, **k))
    processors.fir(table, h, block=16)
    assert blocks == [1 << 14]


@pytest.mark.parametrize("name, moves", [("resample_frames", 1), ("delay_frame_sizes", 2)])
def test_lines_of_orders_move_once(spark, name, moves):
    from tidewell import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.rindex("Initial Plan") :] if "Initial Plan" in plan else plan
    assert len([line for line in initial.splitlines() if "Exchange" in line]) == moves


def test_tasks_grow_with_lines(spark, monkeypatch):
    from tidewell import catalog

    monkeypatch.setattr(catalog, "TASK_LINES", 100)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert catalog.order_frames(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-lines // 100)
