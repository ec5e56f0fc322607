"""A replayable stream of captured messages, and sinks that take every micro-batch once.

Captures are files of messages behind four bytes of length, which may still grow; a length of zero ends one. An offset says for every file how many
bytes and messages have been read, always at a message's border, so a query that starts again from its checkpoint reads each message once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewell.model import InvalidData
from tidewell.sources.storage import SPLIT, Bytes, matching, taker

#: Bytes read at once in search of lengths.
LOOK = 1 << 20
#: Parts of a batch at most: where there is more, parts are larger.
MOST_PARTS = 256
MESSAGES = "stream_id string, seq bigint, data binary"


@dataclass
class Part(InputPartition):
    """Messages of a file from one border to another."""

    path: str
    at: int
    end: int
    seq: int


def borders(path: str, at: int, seq: int, end: int, every: int) -> list[tuple[int, int]]:
    """(place, messages before it) from ``at`` on: where whole messages end, about every so many bytes and at the last of them."""
    out = [(at, seq)]
    with Bytes(path, end) as data:
        held, first = b"", at
        while at + 4 <= end:
            # the lengths of short messages come from a buffer; long ones are passed over unread
            if not first <= at <= first + len(held) - 4:
                held, first = data.read(at, LOOK), at
            size = int.from_bytes(held[at - first : at - first + 4], "big")
            if size == 0 or at + 4 + size > end:
                break
            at, seq = at + 4 + size, seq + 1
            if at - out[-1][0] >= every:
                out.append((at, seq))
    if out[-1][0] != at:
        out.append((at, seq))
    return out


class MessageStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.known: dict[str, dict[str, int]] = {}
        #: Borders that have been met on the way to the known ends, about a split apart.
        self.marks: dict[str, list[tuple[int, int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All whole messages that are there; a reader that has just started looks through the lengths from the files' starts."""
        for path, size in matching(self.path):
            k = self.known.get(path, {"at": 0, "seq": 0})
            if size > k["at"]:
                met = borders(path, k["at"], k["seq"], size, self.split)
                self.marks.setdefault(path, [(k["at"], k["seq"])]).extend(met[1:])
                self.known[path] = dict(zip(("at", "seq"), met[-1]))
        return {path: dict(k) for path, k in self.known.items() if k["at"]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        sinces = {path: start.get(path, {"at": 0, "seq": 0}) for path in end}
        every = max(self.split, sum(to["at"] - sinces[path]["at"] for path, to in end.items()) // MOST_PARTS)
        out = []
        for path, to in sorted(end.items()):
            first, last = ((p["at"], p["seq"]) for p in (sinces[path], to))
            marks = self.between(path, first, last)
            taken = [marks[0]]
            for mark in marks[1:]:
                if mark[0] - taken[-1][0] >= every or mark == last:
                    taken.append(mark)
            out += [Part(path, at, until, seq) for (at, seq), (until, _) in zip(taken, taken[1:])]
        return out

    def between(self, path: str, first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
        """Borders from one to another, both included; a reader that has not met them looks for them."""
        met = self.marks.get(path, [])
        a, b = bisect_left(met, first), bisect_left(met, last)
        if a < len(met) and met[a] == first and b < len(met) and met[b] == last:
            return met[a : b + 1]
        return borders(path, *first, last[0], self.split)

    def read(self, partition: Part):
        with Bytes(partition.path, partition.end) as data:
            take = taker(data, partition.at)
            seq = partition.seq
            while len(head := take(4)) == 4:
                yield partition.path, seq, take(int.from_bytes(head, "big"))
                seq += 1


class MessageReader(DataSourceReader):
    """The same for a batch: what is there now."""

    def __init__(self, options):
        self.stream = MessageStream(options)

    def partitions(self):
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition):
        return self.stream.read(partition)


class MessageSource(DataSource):
    """``spark.readStream.format("tidewell-messages").load(folder or pattern)``; ``split``: bytes that a task reads."""

    @classmethod
    def name(cls):
        return "tidewell-messages"

    def schema(self):
        return MESSAGES

    def streamReader(self, schema):
        return MessageStream(self.options)

    def reader(self, schema):
        return MessageReader(self.options)


Sink = Callable[[DataFrame, int], None]


def table(path: str) -> Sink:
    """A sink that keeps every batch in a folder of its own, which a repeated batch replaces."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class Ledger:
    """Which sink has taken which batch: an empty file each, in a folder that Spark's own file system reaches."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def place(self, sink: str, batch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{sink}/{batch}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, sink: str, batch: int) -> bool:
        system, path = self.place(sink, batch)
        return system.exists(path)

    def enter(self, sink: str, batch: int) -> None:
        system, path = self.place(sink, batch)
        system.create(path, True).close()


def to_sinks_once(stream: DataFrame, sinks: dict[str, Sink], checkpoint: str, **options):
    """Every micro-batch to all sinks (by name), computed once; a batch that comes again goes only to those that have not taken it.

    The first sink that fails ends the query, and no later sink sees that batch before it has come again. A sink that ends well and
    whose entry is lost takes the batch again under the same number, so it should replace what it wrote (``table`` does).
    """
    if not sinks:
        raise InvalidData("a sink at least")

    def take(df: DataFrame, batch: int) -> None:
        ledger = Ledger(df.sparkSession, f"{checkpoint}/sinks")
        open_ = [name for name in sinks if not ledger.has(name, batch)]
        if not open_:
            return
        kept = df.persist()
        try:
            for name in open_:
                sinks[name](kept, batch)
                ledger.enter(name, batch)
        finally:
            kept.unpersist()

    trigger = options.pop("trigger", None)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).options(**options)
    return (writer.trigger(**trigger) if trigger else writer).start()
