"""Reading and building audio containers, one file's bytes at a time.

These are small helpers that run inside tasks: a file of a batch is one row, and files are spread over tasks by
Spark. Only headers and framing are read here; what lossy frames hold is up to a registered codec.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from tidewell.functions.headers import ADTS_RATES, PACKET_FILE_MAGIC, PACKET_FILE_VERSION
from tidewell.model import InvalidData

# Format tags of the samples that WAV files may hold here.
WAV_PCM, WAV_FLOAT = 1, 3
# kbit/s of MPEG-1 and MPEG-2 layer III frames by index, and rates by version and index.
MP3_BITRATES = {
    1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass
class Wav:
    rate: int
    channels: int
    tag: int
    bits: int
    start: int
    length: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def wav_header(data: bytes) -> Wav:
    return find_wav(lambda at, size: data[at : at + size], len(data))


def find_wav(read: Callable[[int, int], bytes], length: int) -> Wav:
    """Where a WAV file's samples are; chunks other than format and data are passed over, padded to even sizes."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise InvalidData("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        body = at + 8
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", read(body, 16))
        if name == b"data":
            if fmt is None:
                raise InvalidData("the samples come before their format")
            tag, channels, rate, _, _, bits = fmt
            if (tag, bits) not in ((WAV_PCM, 16), (WAV_FLOAT, 32)):
                raise InvalidData("only 16-bit and 32-bit float samples are read")
            return Wav(rate, channels, tag, bits, body, min(size, length - body))
        at = body + size + size % 2
    raise InvalidData("no samples in the file")


def wav_samples(data: bytes, wav: Wav, first: int, count: int) -> np.ndarray:
    """Channels by samples, as 32-bit floats."""
    at = wav.start + first * wav.frame_bytes
    return wav_values(data[at : at + count * wav.frame_bytes], wav)


def wav_values(raw: bytes, wav: Wav) -> np.ndarray:
    if wav.tag == WAV_PCM:
        values = np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768)
    else:
        values = np.frombuffer(raw, "<f4")
    return values.reshape(-1, wav.channels).T


def wav_file(planes: list[np.ndarray], rate: int, kind: str = "pcm16le") -> bytes:
    """A whole WAV file of channels' values within one."""
    body = wav_body(planes, kind)
    channels = len(planes) if np.ndim(planes[0]) else 1
    return wav_head(channels, rate, kind, len(body)) + body


def wav_body(planes: list[np.ndarray], kind: str) -> bytes:
    """Samples of channels in turn."""
    values = np.asarray(planes, np.float64).T
    if kind == "pcm16le":
        held = np.clip(np.nan_to_num(values, nan=0.0), -1, 1) * 32767
        return np.where(held < 0, -np.floor(-held + 0.5), np.floor(held + 0.5)).astype("<i2").tobytes()
    if kind == "f32le":
        return values.astype("<f4").tobytes()
    raise InvalidData("WAV files are written as pcm16le or f32le")


#: Bytes before the samples of the WAV files that are written here.
WAV_HEAD = 44
# Format tag and bits of each encoding of WAV files.
WAV_KINDS = {"pcm16le": (WAV_PCM, 16), "f32le": (WAV_FLOAT, 32)}


def wav_head(channels: int, rate: int, kind: str, size: int) -> bytes:
    """The 44 bytes before ``size`` bytes of samples; sizes beyond 32 bits stand as the largest."""
    if kind not in WAV_KINDS:
        raise InvalidData("WAV files are written as pcm16le or f32le")
    tag, bits = WAV_KINDS[kind]
    step = channels * bits // 8
    head = b"RIFF" + struct.pack("<I", min(36 + size, 2**32 - 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * step, step, bits)
    return head + b"data" + struct.pack("<I", min(size, 2**32 - 1))


def adts_packets(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """Payload, rate, time stamp and duration (samples) of each frame; bytes that start no frame are passed over."""
    at = pts = 0
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF0 != 0xF0:
            at += 1
            continue
        header = 7 if data[at + 1] & 1 else 9
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if size < header or at + size > len(data):
            at += 1
            continue
        index = data[at + 2] >> 2 & 15
        samples = 1024 * ((data[at + 6] & 3) + 1)
        yield data[at + header : at + size], ADTS_RATES[index] if index < len(ADTS_RATES) else 0, pts, samples
        pts += samples
        at += size


def id3_size(data: bytes, length: int | None = None) -> int:
    """Bytes of a leading tag, its own ten included, as far as the file (of ``length`` bytes, by default ``data``) goes."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    size = 0
    for b in data[6:10]:
        size = size << 7 | b & 0x7F
    return min(len(data) if length is None else length, size + 10)


def mp3_packets(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Frame, rate and samples of each layer III frame after a leading tag."""
    at = id3_size(data)
    while at + 4 <= len(data):
        b1, b2 = data[at + 1], data[at + 2]
        version, layer = b1 >> 3 & 3, b1 >> 1 & 3
        rate_index, bit_index = b2 >> 2 & 3, b2 >> 4
        if data[at] != 0xFF or b1 & 0xE0 != 0xE0 or layer != 1 or version == 1 or rate_index == 3 or not 0 < bit_index < 15:
            at += 1
            continue
        full = version == 3
        rate = MP3_RATES[version][rate_index]
        size = (144 if full else 72) * MP3_BITRATES[1 if full else 2][bit_index] * 1000 // rate + (b2 >> 1 & 1)
        if at + size > len(data):
            return
        yield data[at : at + size], rate, 1152 if full else 576
        at += size


def ogg_packets(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Packets of the first logical stream of an Ogg file and the granule position of the page on which they end."""
    at, held, serial = 0, b"", None
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        granule, own, segments = struct.unpack_from("<q", data, at + 6)[0], data[at + 14 : at + 18], data[at + 26]
        table = data[at + 27 : at + 27 + segments]
        body = at + 27 + segments
        serial = own if serial is None else serial
        for size in table:
            if own == serial:
                held += data[body : body + size]
                if size < 255:
                    yield held, granule
                    held = b""
            body += size
        at = body


#: Each byte with its bits in reverse.
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """Checksum of an Ogg page: polynomial 0x04C11DB7, most significant bit first, from zero.

    It is the common checksum of the bytes with their bits in the other order, begun and ended without complements.
    """
    c = zlib.crc32(data.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def ogg_file(packets: list[tuple[bytes, int]], heads: list[bytes], serial: int = 1) -> bytes:
    """An Ogg stream: header packets on pages of their own, then a page a packet with the granule at its end."""
    out = []
    everything = [(h, 0) for h in heads] + packets
    for i, (packet, granule) in enumerate(everything):
        lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        if len(lacing) > 255:
            raise InvalidData("a packet fills one page at most")
        flags = (2 if i == 0 else 0) | (4 if i == len(everything) - 1 else 0)
        head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, i, 0) + bytes([len(lacing)]) + lacing
        page = head + packet
        out.append(page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:])
    return b"".join(out)


def ogg_pages(packet: bytes, granule: int, number: int, last: bool = False, first: bool = False, serial: int = 1) -> bytes:
    """A packet on pages of its own, as many as it takes; the last of them has the granule."""
    lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    out = []
    for k, at in enumerate(range(0, len(lacing), 255)):
        table = lacing[at : at + 255]
        ends = at + 255 >= len(lacing)
        flags = (1 if k else 0) | (2 if first and not k else 0) | (4 if last and ends else 0)
        head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule if ends else -1, serial, number + k, 0) + bytes([len(table)]) + table
        page = head + packet[at * 255 : at * 255 + sum(table)]
        out.append(page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:])
    return b"".join(out)


Take = Callable[[int], bytes]


def packet_file_head(take: Take) -> tuple[int, int, bytes]:
    """Time base and extra data; ``take`` gives the next bytes of the file, fewer at its end."""
    head = take(19)
    if head[:8] != PACKET_FILE_MAGIC or head[8] != PACKET_FILE_VERSION:
        raise InvalidData("not a packet file")
    num, den, extra = struct.unpack_from("<iiH", head, 9)
    return num, den, take(extra)


def packet_file_records(take: Take) -> Iterator[tuple[bytes, int]]:
    while len(head := take(8)) == 8:
        size, duration = struct.unpack("<Ii", head)
        yield take(size), duration


def packet_file(data: bytes) -> tuple[int, int, bytes, list[tuple[bytes, int]]]:
    """Time base, extra data and (packet, duration) of a packet file."""
    take = io.BytesIO(data).read
    return *packet_file_head(take), list(packet_file_records(take))


def messages(take: Take) -> Iterator[bytes]:
    """Messages behind four bytes of length each; a length of zero ends them."""
    while len(head := take(4)) == 4 and (size := int.from_bytes(head, "big")):
        yield take(size)


def length_prefixed(data: bytes) -> list[bytes]:
    return list(messages(io.BytesIO(data).read))
