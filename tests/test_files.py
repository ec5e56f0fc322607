"""Files by ranges: the same rows at any size of range, whole files or none, and many tasks a file."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.model import AudioFormat, InvalidData
from tidewell.operators import framing
from tidewell.sources import containers, files, scans, storage


def adts_frame(payload, blocks=0, crc=False):
    size = len(payload) + (9 if crc else 7)
    return bytes([0xFF, 0xF0 if crc else 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC | blocks]) + bytes(2 if crc else 0) + payload


def mp3_frame(rnd, index):
    data = bytes([0xFF, 0xFB, index << 4, 0])
    size = 144 * containers.MP3_BITRATES[1][index] * 1000 // 44100
    return data + noise(rnd, size - 4)


def noise(rnd, n):
    """Bytes among which sync words are frequent."""
    return bytes(rnd.choice([0xFF, 0xFB, 0xF1, 0x50, 0x90, 0x80, 0x10, 0x00, 0x1F, rnd.randrange(256)]) for _ in range(n))


def files_of(rnd, kind):
    if kind == "adts":
        whole = b"".join(adts_frame(noise(rnd, rnd.randrange(0, 400)), rnd.randrange(4), rnd.random() < 0.3) + noise(rnd, rnd.choice([0, 0, 0, 30])) for _ in range(40))
        return [noise(rnd, 50) + whole, whole + adts_frame(bytes(300))[:100], b"", noise(rnd, 3000), b"\xff"]
    whole = b"".join(mp3_frame(rnd, rnd.randrange(1, 15)) + noise(rnd, rnd.choice([0, 0, 20])) for _ in range(15))
    tag = b"ID3\x04\x00\x00\x00\x00\x01\x05" + noise(rnd, 133)
    return [tag + whole, whole + mp3_frame(rnd, 9)[:50], tag[:60], noise(rnd, 3000), b"ID3"]


def put(folder, blobs, suffix):
    os.makedirs(folder, exist_ok=True)
    for i, b in enumerate(blobs):
        with open(f"{folder}/{i}.{suffix}", "wb") as f:
            f.write(b)
    return str(folder)


def rows(df):
    return sorted((os.path.basename(r.stream_id), r.seq, bytes(r.data), r.time_base.den, r.pts, r.duration) for r in df.collect())


SERIAL = {
    "adts": lambda b: [(d, rate, pts, n) for d, rate, pts, n in containers.adts_packets(b)],
    "mp3": lambda b: [(d, rate, None, n) for d, rate, n in containers.mp3_packets(b)],
}


@pytest.mark.parametrize("kind,reader", [("adts", files.read_adts), ("mp3", files.read_mp3)])
def test_packets_are_the_same_at_any_split(spark, tmp_path, monkeypatch, kind, reader):
    rnd = random.Random(7)
    blobs = files_of(rnd, kind)
    folder = put(tmp_path / "in", blobs, kind)
    want = sorted((f"{i}.{kind}", seq, *p) for i, b in enumerate(blobs) for seq, p in enumerate(SERIAL[kind](b)))
    assert len(want) > 15
    for split in (97, 1000, 1 << 20):
        assert rows(reader(spark, folder, split)) == want
    monkeypatch.setattr(storage, "opens", lambda path: False)  # as where only Spark's readers open a path
    assert rows(reader(spark, folder, 97)) == want


def test_ranges_of_one_byte_without_spark(tmp_path):
    """The three steps by hand, on ranges down to one byte and on noise alone."""
    rnd = random.Random(11)
    for kind, spec in (("adts", scans.Adts()), ("mp3", scans.Mp3())):
        for b in files_of(rnd, kind) + [noise(rnd, 400) for _ in range(20)]:
            data = storage.Bytes("", len(b), b)
            want = [(i, *p) for i, p in enumerate(SERIAL[kind](b))]
            for split in (1, 13, 256):
                place, number, samples, got = spec.start(data), 0, 0, []
                for first in range(0, len(b), split):
                    last = min(first + split, len(b))
                    place = max(place, first)
                    if place < last:
                        got += spec.packets(data, place, last, number, samples)
                        at, leaves, n, k = scans.passages(spec.units(data, first, last), first, last, spec.most)
                        i = int(np.searchsorted(at, place))
                        place, number, samples = (leaves[i], number + n[i], samples + k[i]) if i < len(at) else (last, number, samples)
                assert got == want


def ogg_blob(rnd, packets, serial=1):
    out = containers.ogg_pages(b"OpusHead", 0, 0, first=True, serial=serial) + containers.ogg_pages(b"OpusTags", 0, 1, serial=serial)
    number = 2
    for i, p in enumerate(packets):
        page = containers.ogg_pages(p, 960 * (i + 1), number, i == len(packets) - 1, serial=serial)
        number += page.count(b"OggS")
        out += page
        if rnd.random() < 0.3:  # another stream in between
            out += containers.ogg_pages(noise(rnd, 300), 5, i, serial=9)
        if rnd.random() < 0.2:  # what is no page
            out += b"OggS" + noise(rnd, 40)
    return out


def test_ogg_packets_are_the_same_at_any_split(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    sizes = [0, 1, 254, 255, 256, 700, 65_024, 65_025, 70_000, 200_000, 510]
    packets = [noise(rnd, n) for n in sizes]
    packets[5] = containers.ogg_pages(b"a page within a packet", 1, 1) + packets[5]
    cut = ogg_blob(rnd, packets)
    blobs = [ogg_blob(rnd, packets), cut[: cut.rindex(packets[-1][-50:])], b"OggS", b""]
    folder = put(tmp_path / "in", blobs, "ogg")
    want = sorted((f"{f}.ogg", i, p, 48_000, 960 * (i + 1), None) for f in (0, 1) for i, p in enumerate(packets) if f == 0 or i < len(packets) - 1)
    for split in (1000, 66_000, 1 << 20):
        assert rows(files.read_ogg(spark, folder, split)) == want
    monkeypatch.setattr(storage, "opens", lambda path: False)
    assert rows(files.read_ogg(spark, folder, 1000)) == want


def test_checksum_of_pages():
    def plainly(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    rnd = random.Random(2)
    for _ in range(20):
        data = rnd.randbytes(rnd.randrange(0, 80))
        assert containers.ogg_crc(data) == plainly(data)


@pytest.mark.parametrize("kind", ["pcm16le", "f32le"])
def test_wav_frames_are_the_same_at_any_split(spark, tmp_path, monkeypatch, kind):
    rnd = np.random.default_rng(4)
    plain = containers.wav_file([rnd.uniform(-1, 1, 1003), rnd.uniform(-1, 1, 1003)], 8000, kind)
    odd = plain[:12] + b"LIST" + struct.pack("<I", 100_001) + bytes(100_002) + plain[12:]  # a long chunk before the samples
    cut = containers.wav_file([rnd.uniform(-1, 1, 50)], 16000, kind)[:-3]  # ends within a sample
    folder = put(tmp_path / "in", [plain, odd, cut, containers.wav_file([np.zeros(0)], 8000, kind)], "wav")
    seen = lambda df: sorted((os.path.basename(r.stream_id), r.seq, r.pts, r.nb_samples, r.format.sample_rate, r.samples) for r in df.collect())
    want = seen(files.read_wav(spark, folder, 10))
    assert len(want) == 101 + 101 + 5 and {r[3] for r in want} == {10, 3, 8 if kind == "pcm16le" else 9}
    for split in (1, 500, 5000):
        assert seen(files.read_wav(spark, folder, 10, split)) == want
    spark.dataSource.register(files.WavSource)
    for path in (f"{folder}/*.wav", f"file://{folder}", f"{folder}/1.wav"):
        source = spark.read.format("tidewell-wav").option("chunk_samples", "10").option("split", "500").load(path)
        assert seen(source) == [r for r in want if not path.endswith("1.wav") or r[0] == "1.wav"]
    assert source.rdd.getNumPartitions() > 5
    monkeypatch.setattr(storage, "opens", lambda path: False)
    assert seen(files.read_wav(spark, folder, 10, 500)) == want
    with pytest.raises(InvalidData):
        files.read_wav(spark, folder, 0)


def signal_frames(spark, n, size=7):
    rows_ = [(s, c, i, float(((i * 37 + c) % 200 - 100) / 128)) for s, k in (("a/b", n), ("c d*~", n // 3), ("é", 1)) for c in range(2) for i in range(k)]
    return framing.samples_to_frames(spark.createDataFrame(rows_, "stream_id string, ch int, n bigint, v double"), AudioFormat(8000, 2, "f64"), size)


@pytest.mark.parametrize("in_place", [True, False])
def test_many_tasks_write_one_file(spark, tmp_path, monkeypatch, in_place):
    monkeypatch.setattr(framing, "RUN", 5)
    frames = signal_frames(spark, 400)
    pieces = files.wav_pieces(frames, "f32le").repartition(16)
    folder = f"file://{tmp_path}/out"
    told = {r.stream_id: (r.file, r.bytes) for r in storage.write_pieces(pieces, folder, "wav", in_place).collect()}
    assert sorted(os.listdir(tmp_path / "out")) == ["%C3%A9.wav", "a%2Fb.wav", "c%20d%2A~.wav"]
    for stream_id, n in (("a/b", 400), ("c d*~", 133), ("é", 1)):
        want = containers.wav_file([[((i * 37 + c) % 200 - 100) / 128 for i in range(n)] for c in range(2)], 8000, "f32le")
        name = storage.file_name(stream_id, "wav")
        assert (tmp_path / "out" / name).read_bytes() == want
        assert told[stream_id] == (f"{folder}/{name}", len(want))
    back = framing.frames_to_samples(files.read_wav(spark, folder, 16, 300))
    assert back.count() == 2 * 534
    # again: a file of the same name is replaced as a whole
    storage.write_pieces(files.wav_pieces(signal_frames(spark, 10), "f32le"), folder, "wav", in_place)
    assert len((tmp_path / "out" / "a%2Fb.wav").read_bytes()) == 44 + 80


@pytest.mark.parametrize("in_place", [True, False])
def test_a_failed_task_leaves_nothing(spark, tmp_path, in_place):
    kept = spark.createDataFrame([("old", 0, b"kept")], storage.PIECES)
    folder = str(tmp_path / "out")
    storage.write_pieces(kept, folder, "bin", in_place)
    pieces = spark.range(200).select(F.lit("s").alias("stream_id"), F.col("id").alias("at"), F.lit(b"x").alias("data"))
    failing = pieces.withColumn("at", F.when(F.col("at") == 150, F.raise_error("lost").cast("bigint")).otherwise(F.col("at"))).repartition(8)
    with pytest.raises(Exception, match="lost"):
        storage.write_pieces(failing, folder, "bin", in_place)
    assert os.listdir(folder) == ["old.bin"] and (tmp_path / "out" / "old.bin").read_bytes() == b"kept"
    with pytest.raises(Exception, match="do not fill"):  # a piece is missing
        storage.write_pieces(pieces.where("at <> 77"), folder, "bin", in_place)
    assert os.listdir(folder) == ["old.bin"]
    storage.write_pieces(pieces.limit(0), folder, "bin", in_place)
    assert os.listdir(folder) == ["old.bin"]


def test_ogg_files_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(framing, "RUN", 3)
    rnd = random.Random(5)
    packets = [noise(rnd, n) for n in [10, 0, 255, 66_000, 300, 140_000, 1, 2, 3]]
    df = spark.createDataFrame([(s, i, p, 960 + i) for s in "ab" for i, p in enumerate(packets)], "stream_id string, seq bigint, data binary, duration bigint").repartition(7)
    files.write_audio(df, str(tmp_path / "o"), "opus", AudioFormat(48000, 2))
    got = rows(files.read_ogg(spark, str(tmp_path / "o"), 5000))
    ends = np.cumsum([960 + i for i in range(len(packets))]).tolist()
    assert got == [(f"{s}.opus", i, p, 48_000, ends[i], None) for s in "ab" for i, p in enumerate(packets)]
    blob = (tmp_path / "o" / "a.opus").read_bytes()
    assert [p for p, _ in containers.ogg_packets(blob)][2:] == packets
    pages = list(scans.Ogg().in_turn(storage.Bytes("", len(blob), blob), 0, len(blob)))
    assert [struct.unpack_from("<I", blob, p.at + 18)[0] for p in pages] == list(range(len(pages)))
    assert [p.flags & 4 for p in pages] == [0] * (len(pages) - 1) + [4] and pages[0].flags == 2


def test_files_read_from_their_start(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BUFFER", 16)
    messages = [b"a" * 5, b"b" * 100, b"c"]
    body = b"".join(len(m).to_bytes(4, "big") + m for m in messages)
    folder = put(tmp_path / "m", [body + bytes(4) + b"zz", body, b"\0\0", b""], "cap")
    for opens in (True, False):
        monkeypatch.setattr(storage, "opens", lambda path, o=opens: o)
        assert [(r[0], r[1], r[2]) for r in rows(files.read_length_prefixed(spark, folder))] == [(f"{f}.cap", i, m) for f in (0, 1) for i, m in enumerate(messages)]


def test_totals_before_equal_running_sums(spark, monkeypatch):
    monkeypatch.setattr(framing, "RUN", 4)
    rnd = random.Random(1)
    data = {s: [(rnd.randrange(9), rnd.randrange(9)) for _ in range(k)] for s, k in (("a", 30), ("b", 1), ("c", 8))}
    df = spark.createDataFrame([(s, i, x, y) for s, v in data.items() for i, (x, y) in enumerate(v)], "stream_id string, seq bigint, x int, y int").repartition(3)
    got = framing.totals_before(df, {"p": F.col("x"), "q": F.col("y")}, "last").collect()
    assert len(got) == 39
    for r in got:
        before = data[r.stream_id][: r.seq]
        assert (r.p, r.q, r.last) == (sum(x for x, _ in before), sum(y for _, y in before), r.seq == len(data[r.stream_id]) - 1)


def test_short_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(100_000))
    found, tasks, whole = storage.ranges(spark, str(tmp_path / "f"), 100)
    assert found.count() == 1000 and not whole
    assert tasks == found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert storage.tasks_for(spark, 900_000, 15 << 30) == (15 << 30) // storage.TASK_BYTES and storage.tasks_for(spark, 2, 32 << 20) == 2
