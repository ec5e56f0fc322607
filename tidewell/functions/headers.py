"""Headers of encoded streams: building and reading them, as columns over binary values.

Byte access goes through hexadecimal text, so that all of it stays in Spark's own functions.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import Rational

# Sampling rates by index in an ADTS header.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
PACKET_FILE_MAGIC = b"ASTOPUS\x00"
PACKET_FILE_VERSION = 1


def byte_at(data: Column, i: int) -> Column:
    """The i-th byte (from 0) as a number."""
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def read_adts(data: Column) -> Column:
    """Fields of an ADTS header at the start of ``data``; null where there is none."""
    b = [byte_at(data, i) for i in range(7)]
    header = F.when(bits(b[1], 0, 1) == 1, 7).otherwise(9)
    length = F.shiftleft(bits(b[3], 0, 3), 11) + F.shiftleft(b[4], 3) + bits(b[5], 5, 7)
    index = bits(b[2], 2, 15)
    rates = F.array(*map(F.lit, ADTS_RATES))
    fields = F.struct(
        bits(b[2], 6, 3).alias("profile"),
        index.alias("rate_index"),
        F.get(rates, index).alias("sample_rate"),
        (F.shiftleft(bits(b[2], 0, 1), 2) + bits(b[3], 6, 3)).alias("channels"),
        header.alias("header_length"),
        length.alias("frame_length"),
        bits(b[6], 0, 3).alias("raw_blocks"),
    )
    fine = (F.length(data) >= 7) & (b[0] == 255) & (bits(b[1], 4, 15) == 15) & (length >= header)
    return F.when(fine, fields)


def two_digits(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def build_adts(object_type: Column, rate_index: Column, channels: Column, payload_length: Column) -> Column:
    """The seven bytes before a payload, without a checksum; null for no object type or an escaped rate."""
    length = (payload_length + 7).cast("int")
    profile = bits(object_type - 1, 0, 3)
    parts = [
        F.lit(0xFF),
        F.lit(0xF1),
        F.shiftleft(profile, 6) + F.shiftleft(rate_index, 2) + bits(channels, 2, 1),
        F.shiftleft(bits(channels, 0, 3), 6) + bits(length, 11, 3),
        bits(length, 3, 255),
        F.shiftleft(bits(length, 0, 7), 5) + 0x1F,
        F.lit(0xFC),
    ]
    return F.when((object_type > 0) & (rate_index != 15), F.unhex(F.concat(*map(two_digits, parts))))


def build_asc(profile: Column, rate_index: Column, channels: Column) -> Column:
    """The two bytes of an audio configuration that an ADTS header implies."""
    first = F.shiftleft(profile + 1, 3) + bits(rate_index, 1, 7)
    second = F.shiftleft(bits(rate_index, 0, 1), 7) + F.shiftleft(channels, 3)
    return F.unhex(F.concat(two_digits(first), two_digits(second)))


def opus_head(channels: int, input_rate: int) -> bytes:
    """Stream header without pre-skip, gain or channel mapping."""
    return b"OpusHead" + struct.pack("<BBHIhB", 1, channels, 0, input_rate, 0, 0)


def id3_length(data: Column) -> Column:
    """Bytes of an ID3v2 tag at the start of ``data`` (0: none), its own ten included."""
    size = F.lit(0)
    for i in range(6, 10):
        size = F.shiftleft(size, 7) + bits(byte_at(data, i), 0, 127)
    tagged = (F.length(data) >= 10) & (F.substring(data, 1, 3) == F.lit(b"ID3"))
    return F.when(tagged, F.least(size + 10, F.length(data))).otherwise(0)


def little_endian(value: Column, size: int) -> Column:
    """A whole number as ``size`` bytes."""
    text = F.lpad(F.right(F.hex(value.cast("bigint")), F.lit(2 * size)), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * (size - i) - 1, 2) for i in range(size)]))


def packet_file_header(time_base: Rational, extra: bytes) -> bytes:
    return PACKET_FILE_MAGIC + struct.pack("<BiiH", PACKET_FILE_VERSION, time_base.num, time_base.den, len(extra)) + extra


def packet_file_record(data: Column, duration: Column) -> Column:
    """Length, duration and bytes of one packet of a packet file."""
    return F.concat(little_endian(F.length(data), 4), little_endian(F.coalesce(duration, F.lit(0)), 4), data)
