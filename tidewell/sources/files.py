"""Sources and sinks: audio files as frames and packets, generated signals, several sinks at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.model import FILE_FORMATS, FRAMES, PACKETS, AudioFormat, InvalidData, Unsupported, default_layout_mask
from tidewell.operators.framing import totals_before
from tidewell.sources import containers, scans, storage
from tidewell.sources.storage import SPLIT, Bytes, write_pieces

CHUNK_SAMPLES = 1024
#: Frames or packets that a task hands on at once.
ROWS = 256
WAV_FRAMES = "stream_id string, length bigint, rate int, channels int, tag int, bits int, start bigint, size bigint, content binary"


def _in_parts(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """A file's rows a few at a time, so that a task holds its bytes but not all its frames."""
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part)


def wav_frames(stream_id: str, data: Bytes, wav: containers.Wav, chunk_samples: int, first: int, last: int) -> Iterator[dict]:
    """Frames ``first`` to ``last`` (not included) of a file."""
    total = wav.length // wav.frame_bytes
    fmt = {"sample_rate": wav.rate, "channels": wav.channels, "sample_type": "f32", "planar": True, "channel_layout_mask": default_layout_mask(wav.channels)}
    step = max(1, storage.BUFFER // (chunk_samples * wav.frame_bytes))
    for at in range(first, last, step):
        n = min(min(last, at + step) * chunk_samples, total) - at * chunk_samples
        values = containers.wav_values(data.read(wav.start + at * chunk_samples * wav.frame_bytes, n * wav.frame_bytes), wav).astype(float)
        for seq in range(at, min(last, at + step)):
            planes = values[:, (seq - at) * chunk_samples : (seq - at + 1) * chunk_samples]
            yield {
                "stream_id": stream_id, "seq": seq, "pts": seq * chunk_samples, "time_base": {"num": 1, "den": wav.rate}, "format": fmt,
                "nb_samples": planes.shape[1], "samples": planes.tolist(),
            }


def frames_a_range(wav: containers.Wav, chunk_samples: int, split: int) -> tuple[int, int]:
    """Frames of a file, and of a range of about ``split`` bytes."""
    if chunk_samples < 1:
        raise InvalidData("a frame holds one sample at least")
    return -(-(wav.length // wav.frame_bytes) // chunk_samples), max(1, split // (chunk_samples * wav.frame_bytes))


def read_wav(spark: SparkSession, path: str, chunk_samples: int = CHUNK_SAMPLES, split: int = SPLIT) -> DataFrame:
    """Frames of WAV files; the last frame of each is as short as it comes.

    A file is read by as many tasks as it has ranges of about ``split`` bytes; what its header says comes from a first look at each file.
    """
    if chunk_samples < 1:
        raise InvalidData("a frame holds one sample at least")

    def look(batches):
        for pdf in batches:
            rows = []
            for stream_id, length, content in zip(pdf["stream_id"], pdf["length"].tolist(), pdf["content"]):
                with Bytes(stream_id, length, content) as data:
                    w = containers.find_wav(data.read, length)
                    rows.append((stream_id, length, w.rate, w.channels, w.tag, w.bits, w.start, w.length, content))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WAV_FRAMES.split(", ")])

    def run(batches):
        for pdf in batches:
            for stream_id, length, rate, channels, tag, bits, start, size, content, first, last in zip(*(pdf[c].tolist() for c in (*(c.split()[0] for c in WAV_FRAMES.split(", ")), "first", "last"))):
                with Bytes(stream_id, length, content) as data:
                    yield from _in_parts(wav_frames(stream_id, data, containers.Wav(rate, channels, tag, bits, start, size), chunk_samples, first, last))

    looked = storage.files(spark, path).mapInPandas(look, WAV_FRAMES)
    frame = F.col("channels") * F.col("bits") / 8
    total = F.ceil(F.floor(F.col("size") / frame) / chunk_samples)
    if not storage.opens(path):
        return looked.withColumn("first", F.lit(0).cast("bigint")).withColumn("last", total).mapInPandas(run, FRAMES)
    step = F.greatest(F.lit(1), F.floor(split / (frame * chunk_samples)))
    n, length = looked.agg(F.sum(F.ceil(total / step)), F.sum("size")).first()
    n = storage.tasks_for(spark, n or 1, length or 0)
    firsts = F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1, step))
    cuts = looked.where(total > 0).withColumn("first", firsts).withColumn("last", F.least(F.col("first") + step, total))
    return storage.spread(cuts, n, "stream_id", "first").mapInPandas(run, FRAMES)


def read_adts(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """AAC packets of ADTS files, without their headers; time stamps count samples."""
    return scans.read_packets(spark, path, scans.Adts(), split)


def read_mp3(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Layer III frames of MP3 files after a leading tag; no time stamps."""
    return scans.read_packets(spark, path, scans.Mp3(), split)


def read_ogg(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Packets of the first stream of Ogg files, at 48000 a second; the two header packets are passed over."""
    return scans.read_packets(spark, path, scans.Ogg(), split, skip=2, durations=False)


def _in_order(spark: SparkSession, path: str, split: Callable[[Callable[[int], bytes]], Iterator[tuple]]) -> DataFrame:
    """Packets of files that can only be read from their start: (data, time base den, pts or None, duration) of each by ``split``.

    Where a packet begins is known from all lengths before it, so a file is a task; it is read a buffer at a time.
    """

    def run(batches):
        for pdf in batches:
            for stream_id, length, content in zip(pdf["stream_id"], pdf["length"].tolist(), pdf["content"]):
                with Bytes(stream_id, length, content) as data:
                    rows = (
                        {"stream_id": stream_id, "seq": i, "data": d, "time_base": {"num": 1, "den": den}, "pts": pts, "dts": pts, "duration": duration, "flags": 0}
                        for i, (d, den, pts, duration) in enumerate(split(storage.taker(data)))
                    )
                    for out in _in_parts(rows):
                        for c in ("pts", "dts", "duration"):
                            out[c] = out[c].astype("Int64")
                        yield out

    found = storage.files(spark, path)
    return storage.spread(found, found.count(), "stream_id").mapInPandas(run, PACKETS)


def read_packet_file(spark: SparkSession, path: str) -> DataFrame:
    def split(take: Callable[[int], bytes]):
        _, den, _ = containers.packet_file_head(take)
        pts = 0
        for packet, duration in containers.packet_file_records(take):
            yield packet, den, pts, duration
            pts += duration

    return _in_order(spark, path, split)


def read_length_prefixed(spark: SparkSession, path: str) -> DataFrame:
    """Messages of captured streams, each behind four bytes of length."""
    return _in_order(spark, path, lambda take: ((m, 1, None, None) for m in containers.messages(take)))


def read_audio(spark: SparkSession, path: str, kind: str, chunk_samples: int = CHUNK_SAMPLES, fmt: AudioFormat | None = None, split: int = SPLIT) -> DataFrame:
    """Frames of files of one kind; kinds other than WAV need a registered codec, and the format it decodes to."""
    from tidewell.operators.codecs import codec

    known = FILE_FORMATS.get(kind.lower())
    if known == "wav":
        return read_wav(spark, path, chunk_samples, split)
    readers = {"aac": read_adts, "mp3": read_mp3, "opus": read_ogg}
    if known is None:
        raise InvalidData(f"no file format {kind!r}")
    back = codec(known)
    if known not in readers:
        raise Unsupported(f"{known} files are read by a back end of their own")
    return back.decode(readers[known](spark, path, split), fmt)


@dataclass
class WavRange(InputPartition):
    path: str
    length: int
    wav: containers.Wav
    first: int
    last: int


class WavReader(DataSourceReader):
    """A task for each range of ``split`` bytes of each file; ``path`` is a file, or a folder and a pattern of names."""

    def __init__(self, options):
        self.path = options["path"]
        self.chunk_samples = int(options.get("chunk_samples", CHUNK_SAMPLES))
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path, length in storage.matching(self.path):
            with Bytes(path, length) as data:
                wav = containers.find_wav(data.read, length)
            total, step = frames_a_range(wav, self.chunk_samples, self.split)
            out += [WavRange(path, length, wav, at, min(at + step, total)) for at in range(0, total, step)]
        return out

    def read(self, partition):
        with Bytes(partition.path, partition.length) as data:
            for r in wav_frames(partition.path, data, partition.wav, self.chunk_samples, partition.first, partition.last):
                yield (r["stream_id"], r["seq"], r["pts"], tuple(r["time_base"].values()), tuple(r["format"].values()), r["nb_samples"], r["samples"])


class WavSource(DataSource):
    """``spark.read.format("tidewell-wav").option("chunk_samples", n).load(pattern)``"""

    @classmethod
    def name(cls):
        return "tidewell-wav"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return WavReader(self.options)


def write_files(frames: DataFrame, path: str, kind: str = "wav", encoding: str = "pcm16le") -> DataFrame:
    """One file a stream in the folder ``path``, written at once; returns (stream_id, file, bytes).

    Any number of tasks write a file: each frame's place follows from the samples before it (``storage.write_pieces``).
    """
    if FILE_FORMATS.get(kind.lower()) != "wav":
        raise Unsupported(f"no writer for {kind} is registered")
    return write_pieces(wav_pieces(frames, encoding), path, "wav")


def wav_pieces(frames: DataFrame, encoding: str = "pcm16le") -> DataFrame:
    """stream_id, at, data: the bytes of a WAV file for each stream, a piece a frame and one for the header."""
    if encoding not in containers.WAV_KINDS:
        raise InvalidData("WAV files are written as pcm16le or f32le")
    sample_bytes = containers.WAV_KINDS[encoding][1] // 8

    @F.pandas_udf("binary")
    def body(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: containers.wav_body([np.asarray(c, float) for c in p], encoding))

    @F.pandas_udf("binary")
    def head(channels: pd.Series, rate: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([containers.wav_head(c, r, encoding, n) for c, r, n in zip(channels.tolist(), rate.tolist(), size.tolist())])

    step = F.size("samples") * sample_bytes
    length = F.when(F.size("samples") > 0, F.size(F.col("samples")[0])).otherwise(0)
    rows = frames.select("stream_id", "seq", "samples", F.col("format.sample_rate").alias("rate"))
    placed = totals_before(rows, {"at": length * step})
    pieces = placed.select("stream_id", (F.col("at") + containers.WAV_HEAD).alias("at"), body("samples").alias("data"))
    streams = rows.groupBy("stream_id").agg(F.max(F.size("samples")).alias("channels"), F.max("rate").alias("rate"), F.sum((length * step).cast("bigint")).alias("size"))
    return pieces.unionByName(streams.select("stream_id", F.lit(0).cast("bigint").alias("at"), head("channels", "rate", "size").alias("data")))


def packet_blobs(packets: DataFrame, header: bytes = b"") -> DataFrame:
    """stream_id, content: a header and the packets' bytes in order, for streams that are small; others are written by ``packet_pieces``."""
    got = packets.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.hex(p["data"])), "")
    return got.select("stream_id", F.concat(F.lit(header), F.unhex(text)).alias("content"))


def packet_pieces(packets: DataFrame, header: bytes = b"") -> DataFrame:
    """stream_id, at, data: a header and the packets' bytes in order, each at its place."""
    rows = packets.select("stream_id", "seq", "data")
    placed = totals_before(rows, {"at": F.length("data")}).select("stream_id", (F.col("at") + len(header)).alias("at"), "data")
    if not header:
        return placed
    heads = rows.select("stream_id").distinct().select("stream_id", F.lit(0).cast("bigint").alias("at"), F.lit(header).alias("data"))
    return placed.unionByName(heads)


def adts_pieces(packets: DataFrame, object_type: int, sample_rate: int, channels: int) -> DataFrame:
    """stream_id, at, data: AAC packets behind ADTS headers."""
    from tidewell.functions.headers import ADTS_RATES, build_adts

    if sample_rate not in ADTS_RATES:
        raise InvalidData(f"no index for {sample_rate} samples a second")
    head = build_adts(F.lit(object_type), F.lit(ADTS_RATES.index(sample_rate)), F.lit(channels), F.length("data"))
    return packet_pieces(packets.withColumn("data", F.concat(head, "data")))


def opus_pieces(packets: DataFrame, channels: int, input_rate: int = 48_000) -> DataFrame:
    """stream_id, at, data: Opus packets in Ogg pages, behind two header pages.

    Page numbers, granules (samples, from the packets' durations) and places are sums over the packets before, so every packet's pages are
    made where the packet is; a packet of over 65,024 bytes takes several.
    """
    from tidewell.functions.headers import opus_head

    heads = containers.ogg_pages(opus_head(channels, input_rate), 0, 0, first=True) + containers.ogg_pages(b"OpusTags" + bytes(8), 0, 1)

    @F.pandas_udf("binary")
    def pages(data: pd.Series, granule: pd.Series, number: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([containers.ogg_pages(d, g, n, e) for d, g, n, e in zip(data, granule.tolist(), number.tolist(), last.tolist())])

    lacing = F.floor(F.length("data") / 255) + 1
    own = F.ceil(lacing / 255)
    duration = F.coalesce("duration", F.lit(0))
    rows = packets.select("stream_id", "seq", "data", "duration")
    placed = totals_before(rows, {"at": F.length("data") + lacing + 27 * own, "number": own, "granule": duration}, last="last")
    made = pages("data", F.col("granule") + duration, F.col("number") + 2, "last")
    pieces = placed.select("stream_id", (F.col("at") + len(heads)).alias("at"), made.alias("data"))
    return pieces.unionByName(rows.select("stream_id").distinct().select("stream_id", F.lit(0).cast("bigint").alias("at"), F.lit(heads).alias("data")))


def write_audio(df: DataFrame, path: str, kind: str, fmt: AudioFormat | None = None, encoding: str = "pcm16le", object_type: int = 2) -> DataFrame:
    """One file a stream: WAV of frames; AAC, MP3 and Opus of packets that a codec made."""
    known = FILE_FORMATS.get(kind.lower())
    if known == "wav":
        return write_files(df, path, encoding=encoding)
    if known is None or fmt is None:
        raise InvalidData("a known file format and the stream's format are needed")
    if known == "aac":
        return write_pieces(adts_pieces(df, object_type, fmt.sample_rate, fmt.channels), path, "aac")
    if known == "mp3":
        return write_pieces(packet_pieces(df), path, "mp3")
    if known == "opus":
        return write_pieces(opus_pieces(df, fmt.channels, fmt.sample_rate), path, "opus")
    raise Unsupported(f"{known} files are written by a back end of their own")


def write_blobs(blobs: DataFrame, path: str, suffix: str) -> DataFrame:
    """Each row's content as a file of its own in the folder ``path``, named by the stream's id; (stream_id, file, bytes)."""
    return write_pieces(blobs.select("stream_id", F.lit(0).cast("bigint").alias("at"), F.col("content").alias("data")), path, suffix)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Hand ``df`` to all sinks; it is computed once. All are tried, and the first error is raised after them."""
    if not sinks:
        raise InvalidData("a sink at least")
    kept = df.persist()
    errors = []
    try:
        for sink in sinks:
            try:
                sink(kept)
            except Exception as e:  # noqa: BLE001  every sink gets its turn, then the first error is raised
                errors.append(e)
    finally:
        kept.unpersist()
    if errors:
        raise errors[0]


def tap(df: DataFrame, sink: Callable[[DataFrame], None]) -> DataFrame:
    """``df`` unchanged, after ``sink`` has had it; it is computed once for both."""
    kept = df.persist()
    sink(kept)
    return kept


def sines(tones: DataFrame, sample_rate: int = 44_100) -> DataFrame:
    """Samples of a sine that starts at zero for every row (stream_id, frequency, amplitude, seconds, channels) of ``tones``."""
    n = F.floor(F.col("seconds") * sample_rate).cast("bigint")
    each = tones.where(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("n"))
    v = F.sin(F.col("n") * (2 * math.pi / sample_rate) * F.col("frequency")) * F.col("amplitude")
    return each.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("channels").cast("int") - 1)).alias("ch"), "n", v.alias("v"))


def sine(spark: SparkSession, seconds: float, frequency: float = 440.0, amplitude: float = 0.2, sample_rate: int = 44_100, channels: int = 2, stream_id: str = "sine") -> DataFrame:
    """Samples of a sine that starts at zero, the same in all channels."""
    n = int(seconds * sample_rate)
    v = F.sin(F.col("id") * (2 * math.pi * frequency / sample_rate)) * amplitude
    return spark.range(n).select(
        F.lit(stream_id).alias("stream_id"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch"), F.col("id").alias("n"), v.alias("v")
    )
