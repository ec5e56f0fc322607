"""Packets of ADTS, MP3 and Ogg files by ranges of bytes, the same at any size of range.

A reader that goes through a file from its start is, at a range's border, at one place: where the last unit (frame or page)
before the border ended, or at the border. Ranges are scanned in three steps:

1. each task finds the units that may start in its range, and where a reader would leave the range, with how many packets and samples,
   from each of the first places at which it may enter (the ways soon meet, so these are few);
2. a pass over a file's ranges, a short row each, says where the reader enters each one, and the packets and samples before it;
3. each task follows the units of its range from there.

So nothing is guessed from the bytes around a border, and time stamps and positions are those of the whole file.
"""

from __future__ import annotations

import struct
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewell.functions.headers import ADTS_RATES
from tidewell.model import PACKETS
from tidewell.sources.containers import MP3_BITRATES, MP3_RATES, id3_size, ogg_crc
from tidewell.sources.storage import SPLIT, Bytes, ranges, spread

#: Packets that a task hands on at once, and bytes beyond which it hands on fewer.
ROWS, ROWS_BYTES = 4096, 1 << 20
PASSAGES = "stream_id string, length bigint, first bigint, last bigint, start bigint, at array<bigint>, leaves array<bigint>, packets array<bigint>, samples array<bigint>"
ENTRIES = "stream_id string, length bigint, first bigint, last bigint, entry bigint, packets bigint, samples bigint"


@dataclass
class Units:
    """Units that may start in a stretch of a file, by place: where each ends, and the packets and samples that it counts for."""

    at: np.ndarray
    end: np.ndarray
    packets: np.ndarray
    samples: np.ndarray


class Format(ABC):
    #: Bytes that a unit takes at most; so far behind its start a reader may look.
    most: int

    def start(self, data: Bytes) -> int:
        """Where the first unit may start."""
        return 0

    @abstractmethod
    def units(self, data: Bytes, first: int, last: int) -> Units: ...

    @abstractmethod
    def packets(self, data: Bytes, entry: int, last: int, number: int, samples: int) -> Iterator[tuple]:
        """(seq, bytes, ticks a second, time stamp, duration) of the units from ``entry`` that start before ``last``."""


def onwards(units: Units, place: int) -> Iterator[int]:
    """Indices of the units that a reader at ``place`` meets."""
    i = int(np.searchsorted(units.at, place))
    while i < len(units.at):
        yield i
        i = int(np.searchsorted(units.at, units.end[i]))


def passages(units: Units, first: int, last: int, most: int) -> tuple[list, list, list, list]:
    """Places of units at which a reader may enter, where it then leaves, and the packets and samples between."""
    n = len(units.at)
    nexts = np.searchsorted(units.at, units.end).tolist()
    leaves, packets, samples = np.maximum(units.end, last).tolist(), units.packets.tolist(), units.samples.tolist()
    for i in range(n - 1, -1, -1):
        j = nexts[i]
        if j < n:
            leaves[i] = leaves[j]
            packets[i] += packets[j]
            samples[i] += samples[j]
    k = min(n, int(np.searchsorted(units.at, first + most, side="right")) + 1)
    return units.at[:k].tolist(), leaves[:k], packets[:k], samples[:k]


class Framed(Format):
    """Formats whose units are frames behind a header of fixed size, one packet each."""

    header: int

    @abstractmethod
    def frames(self, d: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
        """Places of headers in ``d``, sizes, samples, and whether the frame is to be handed on; ``end``: where the file ends."""

    @abstractmethod
    def packet(self, data: bytes) -> tuple[bytes, int]: ...

    stamped = True

    def units(self, data: Bytes, first: int, last: int) -> Units:
        return self.within(data.read(first, last - first + self.header - 1), first, last, data.length)

    def within(self, held: bytes, first: int, last: int, length: int) -> Units:
        at, end, packets, samples = self.frames(np.frombuffer(held, np.uint8), length - first)
        own = at < last - first
        return Units(at[own] + first, end[own] + first, packets[own], samples[own])

    def packets(self, data: Bytes, entry: int, last: int, number: int, samples: int) -> Iterator[tuple]:
        held = data.read(entry, last - entry + self.most)
        units = self.within(held[: last - entry + self.header - 1], entry, last, data.length)
        for i in onwards(units, entry):
            if units.packets[i]:
                body, rate = self.packet(held[units.at[i] - entry : units.end[i] - entry])
                n = int(units.samples[i])
                yield number, body, rate, samples if self.stamped else None, n
                number += 1
                samples += n


class Adts(Framed):
    header, most = 7, 8191

    def frames(self, d, end):
        at = np.flatnonzero((d[:-6] == 0xFF) & (d[1:-5] & 0xF0 == 0xF0)) if len(d) >= 7 else np.zeros(0, np.int64)
        b = [d[at + i].astype(np.int64) for i in range(7)]
        size = (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
        whole = (size >= np.where(b[1] & 1, 7, 9)) & (at + size <= end)
        at, size = at[whole], size[whole]
        return at, at + size, np.ones(len(at), np.int64), 1024 * ((b[6][whole] & 3) + 1)

    def packet(self, data):
        index = data[2] >> 2 & 15
        return data[7 if data[1] & 1 else 9 :], ADTS_RATES[index] if index < len(ADTS_RATES) else 0


class Mp3(Framed):
    header, most, stamped = 4, 1 << 13, False

    def start(self, data):
        return id3_size(data.read(0, 10), data.length)

    def frames(self, d, end):
        at = np.flatnonzero((d[:-3] == 0xFF) & (d[1:-2] & 0xE0 == 0xE0)) if len(d) >= 4 else np.zeros(0, np.int64)
        b1, b2 = d[at + 1].astype(np.int64), d[at + 2].astype(np.int64)
        version, bits, rates = b1 >> 3 & 3, b2 >> 4, b2 >> 2 & 3
        fine = (b1 >> 1 & 3 == 1) & (version != 1) & (rates != 3) & (bits > 0) & (bits < 15)
        at, b2, version, bits, rates = at[fine], b2[fine], version[fine], bits[fine], rates[fine]
        full = version == 3
        rate = np.array([MP3_RATES.get(v, (1, 1, 1)) for v in range(4)])[version, rates]
        kbits = np.where(full, np.array(MP3_BITRATES[1])[bits], np.array(MP3_BITRATES[2])[bits])
        stop = at + np.where(full, 144, 72) * kbits * 1000 // rate + (b2 >> 1 & 1)
        cut = stop > end  # the file ends within the frame: a reader stops there
        return at, np.where(cut, end, stop), np.where(cut, 0, 1), np.where(cut, 0, np.where(full, 1152, 576))

    def packet(self, data):
        return data, MP3_RATES[data[1] >> 3 & 3][data[2] >> 2 & 3]


@dataclass
class Page:
    at: int
    end: int
    flags: int
    granule: int
    serial: bytes
    pieces: list[bytes]
    #: Whether the last piece goes on in the next page.
    open: bool

    @property
    def begins(self) -> int:
        """Packets that begin here."""
        return len(self.pieces) - (1 if self.pieces and self.flags & 1 else 0)


class Ogg(Format):
    """Pages with a right checksum; bytes between such pages are passed over."""

    most = 27 + 255 + 255 * 255

    def page(self, held: bytes, at: int, base: int) -> Page | None:
        if len(held) < at + 27 or held[at + 4]:
            return None
        n = held[at + 26]
        table = held[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if len(table) < n or end > len(held) or ogg_crc(held[at : at + 22] + bytes(4) + held[at + 26 : end]) != struct.unpack_from("<I", held, at + 22)[0]:
            return None
        pieces, body, from_ = [], at + 27 + n, at + 27 + n
        for size in table:
            body += size
            if size < 255:
                pieces.append(held[from_:body])
                from_ = body
        unfinished = bool(table) and table[-1] == 255
        if unfinished:
            pieces.append(held[from_:body])
        return Page(base + at, base + end, held[at + 5], struct.unpack_from("<q", held, at + 6)[0], held[at + 14 : at + 18], pieces, unfinished)

    def pages(self, data: Bytes, first: int, last: int) -> Iterator[Page]:
        """All pages that start in a stretch, those within others' bodies included."""
        held = data.read(first, last - first + self.most)
        at = held.find(b"OggS")
        while 0 <= at < last - first:
            if (page := self.page(held, at, first)) is not None:
                yield page
            at = held.find(b"OggS", at + 1)

    def in_turn(self, data: Bytes, place: int, last: int) -> Iterator[Page]:
        """Pages as a reader meets them, to the file's end; what lies beyond ``last`` is read a little at a time."""
        while place < data.length:
            last = min(last if place < last else place + self.most, data.length)
            for page in self.pages(data, place, last):
                if page.at >= place:
                    yield page
                    place = page.end
            place = max(place, last)

    def serial(self, data: Bytes) -> bytes | None:
        return next((p.serial for p in self.in_turn(data, 0, 0)), None)

    def units(self, data, first, last):
        own = self.serial(data)
        found = list(self.pages(data, first, last))
        column = lambda values: np.array(values, np.int64)
        return Units(column([p.at for p in found]), column([p.end for p in found]), column([p.begins if p.serial == own else 0 for p in found]), column([0] * len(found)))

    def packets(self, data, entry, last, number, samples):
        """A packet belongs to the page on which it begins; the rest of it is read beyond the range."""
        own, held = self.serial(data), None
        for page in self.in_turn(data, entry, last):
            if page.at >= last and held is None:
                return
            if page.serial != own:
                continue
            pieces = page.pieces
            if page.flags & 1 and pieces:
                if held is not None:
                    held = held + pieces[0]
                    if len(pieces) == 1 and page.open:
                        continue
                    yield number - 1, held, 48_000, page.granule if page.granule >= 0 else None, None
                    held = None
                pieces = pieces[1:]
            held = None
            if page.at >= last:
                return
            for i, piece in enumerate(pieces):
                number += 1
                if page.open and i == len(pieces) - 1:
                    held = piece
                else:
                    yield number - 1, piece, 48_000, page.granule if page.granule >= 0 else None, None


def entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where a reader enters each range of a file, and what it has met before."""
    pdf = pdf.sort_values("first")
    place, packets, samples = int(pdf["start"].iloc[0]), 0, 0
    rows = []
    for stream_id, length, first, last, at, leaves, n, k in zip(*(pdf[c].tolist() for c in ("stream_id", "length", "first", "last", "at", "leaves", "packets", "samples"))):
        place = max(place, first)
        if place < last:
            rows.append((stream_id, length, first, last, place, packets, samples))
            i = int(np.searchsorted(at, place))
            if i < len(at):
                place, packets, samples = int(leaves[i]), packets + int(n[i]), samples + int(k[i])
            else:
                place = last
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])


def read_packets(spark: SparkSession, path: str, kind: Format, split: int = SPLIT, skip: int = 0, durations: bool = True) -> DataFrame:
    """Packets of all files at ``path``; the first ``skip`` of each are passed over."""
    found, n, whole = ranges(spark, path, split)

    def look(batches):
        for pdf in batches:
            rows = []
            for stream_id, length, first, last in zip(*(pdf[c].tolist() for c in ("stream_id", "length", "first", "last"))):
                with Bytes(stream_id, length) as data:
                    rows.append((stream_id, length, first, last, kind.start(data), *passages(kind.units(data, first, last), first, last, kind.most)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    def packets(pdf):
        content = pdf["content"] if "content" in pdf else [None] * len(pdf)
        for stream_id, length, last, entry, before, samples, whole in zip(*(pdf[c].tolist() for c in ("stream_id", "length", "last", "entry", "packets", "samples")), content):
            with Bytes(stream_id, length, whole) as data:
                if entry < 0:
                    entry = kind.start(data)
                for seq, body, den, pts, k in kind.packets(data, entry, last, before, samples):
                    if seq >= skip:
                        yield stream_id, seq - skip, body, den, pts, k

    def follow(batches):
        for pdf in batches:
            # ranges may be short, so rows are handed on across them
            part, size = [], 0
            for row in packets(pdf):
                part.append(row)
                size += len(row[2])
                if len(part) >= ROWS or size >= ROWS_BYTES:
                    yield made(part)
                    part, size = [], 0
            if part:
                yield made(part)

    def made(part):
        stream_id, seq, body, den, pts, k = zip(*part)
        pts = pd.array(pts, dtype="Int64")
        return pd.DataFrame(
            {"stream_id": stream_id, "seq": seq, "data": body, "time_base": [{"num": 1, "den": d} for d in den], "pts": pts, "dts": pts, "duration": pd.array(k if durations else [None] * len(k), dtype="Int64"), "flags": 0}
        )

    if whole:
        return found.selectExpr("stream_id", "length", "last", "-1L entry", "0L packets", "0L samples", "content").mapInPandas(follow, PACKETS)
    seen = found.drop("content").mapInPandas(look, PASSAGES)
    entries = spread(seen.groupBy("stream_id").applyInPandas(entered, ENTRIES), n, "stream_id", "first")
    return entries.mapInPandas(follow, PACKETS)
