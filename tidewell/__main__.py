"""``python -m tidewell IN OUT [--rate N]``: read audio, resample it, write it as OUT's ending says (or WAV files into a folder).

IN is a file, a folder or a pattern of names of one kind. OUT's last part names the format by its ending; the files, one a stream, go
into a folder of that name. Kinds other than WAV need a registered codec and, to be read, the format it decodes to (``--decoded``).
"""

from __future__ import annotations

import argparse
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from tidewell.model import FILE_FORMATS, AudioFormat, InvalidData
from tidewell.operators import codecs, framing, processors
from tidewell.sources import files


def kind_of(path: str, otherwise: str | None = None) -> str:
    """The file format that a path's ending names."""
    ending = PurePath(path).suffix.lstrip(".").lower()
    known = FILE_FORMATS.get(ending, otherwise)
    if known is None:
        raise InvalidData(f"no file format {ending!r}")
    return known


def format_of(text: str) -> AudioFormat:
    """Rate, channels and sample type: ``48000,2,f32``."""
    rate, channels, *kind = text.split(",")
    return AudioFormat(int(rate), int(channels), *kind)


def transcode(spark: SparkSession, source: str, target: str, rate: int | None = None, encoding: str = "pcm16le", decoded: AudioFormat | None = None) -> DataFrame:
    """Write ``source`` as ``target`` says; (stream_id, file, bytes) of what was written."""
    to = kind_of(target, "wav")
    if to != "wav":
        codecs.codec(to)  # fails now if there is none
    frames = files.read_audio(spark, source, kind_of(source), fmt=decoded)
    first = frames.select("format").first()
    if first is None:
        return files.write_files(frames, target, encoding=encoding)
    f = first["format"]
    fmt = AudioFormat(rate or f["sample_rate"], f["channels"], f["sample_type"])
    samples = framing.frames_to_samples(frames)
    if fmt.sample_rate != f["sample_rate"]:
        samples = processors.resample(samples, f["sample_rate"], fmt.sample_rate, narrow=True)
    if to == "wav":
        unit = processors.convert(samples, fmt.sample_type, "f32")
        return files.write_files(framing.samples_to_frames(unit, AudioFormat(fmt.sample_rate, fmt.channels, "f32"), files.CHUNK_SAMPLES), target, encoding=encoding)
    return files.write_audio(codecs.encode(samples, to, fmt), target, to, fmt)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--rate", type=int, help="samples a second of the result")
    parser.add_argument("--encoding", choices=("pcm16le", "f32le"), default="pcm16le")
    parser.add_argument("--decoded", type=format_of, help="rate, channels and sample type that encoded files decode to, as 48000,2,f32")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    for row in transcode(spark, a.source, a.target, a.rate, a.encoding, a.decoded).toLocalIterator():
        print(row["file"], row["bytes"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
