"""Files by byte ranges: the tasks that need a range open the file and read it; writers put pieces in their places.

Paths are those that Spark's readers list. Tasks open them by Arrow's file systems (local and mounted folders, HDFS, object
stores); where those cannot open a scheme, Spark's reader hands over whole files instead, and a file is one range.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewell.model import InvalidData, InvalidState

#: Bytes of a range that a task reads at once.
SPLIT = 16 << 20
#: Bytes of ranges that a task takes at least, where there are more ranges than cores; short ranges are dealt many to a task.
TASK_BYTES = 4 << 20
#: Tasks that share the ranges of a scan, at most.
MOST_TASKS = 20_000
#: Bytes that a writer gathers before it writes.
BUFFER = 4 << 20
RANGES = "stream_id string, length bigint, first bigint, last bigint, content binary"
PIECES = "stream_id string, at bigint, data binary"


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return arrow_fs.LocalFileSystem(), path
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/")
    system, root = arrow_fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{inner}"


class Bytes:
    """A file's bytes, from an opened file or from what Spark's reader brought."""

    def __init__(self, path: str, length: int, content: bytes | None = None):
        self.length = length
        self.content = content
        self.file = None
        if content is None:
            system, inner = located(path)
            self.file = system.open_input_file(inner)

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    def read(self, at: int, size: int) -> bytes:
        """At most ``size`` bytes from ``at`` on, fewer only at the file's end."""
        size = min(size, self.length - at)
        if size <= 0:
            return b""
        return self.content[at : at + size] if self.file is None else self.file.read_at(size, at)


def taker(data: Bytes, at: int = 0) -> Callable[[int], bytes]:
    """A function that gives the file's next bytes from ``at`` on, read a buffer at a time."""
    held, used = b"", 0

    def take(size: int) -> bytes:
        nonlocal at, held, used
        if used + size > len(held):
            rest = held[used:]
            more = data.read(at, max(size - len(rest), BUFFER))
            at += len(more)
            held, used = rest + more, 0
        out = held[used : used + size]
        used += len(out)
        return out

    return take


def matching(pattern: str) -> list[tuple[str, int]]:
    """Files (place, bytes) that a path names: itself, or those of a folder whose names match its last part."""
    system, inner = located(pattern)
    outer = pattern[: len(pattern) - len(inner)] if pattern.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.is_file:
        return [(pattern, info.size)]
    folder, _, name = (inner, "", "*") if info.type == arrow_fs.FileType.Directory else inner.rpartition("/")
    found = system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return sorted((outer + f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name) and not f.base_name.startswith(("_", ".")))


def opens(path: str) -> bool:
    try:
        located(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (the file's place), length, content: content is null where tasks can open the files themselves."""
    found = spark.read.format("binaryFile").load(path)
    content = F.lit(None).cast("binary") if opens(path) else F.col("content")
    return found.select(F.col("path").alias("stream_id"), "length", content.alias("content"))


def tasks_for(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for ``n`` ranges of ``size`` bytes in all."""
    return min(n, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Small rows that each stand for much work, dealt to ``n`` tasks."""
    return rows.repartition(max(1, min(n, MOST_TASKS)), *keys)


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, int, bool]:
    """Ranges (``RANGES``) of ``split`` bytes of all files, how many tasks share them, and whether they are whole files that Spark's reader brings."""
    if split < 1:
        raise InvalidData("a range holds one byte at least")
    found = files(spark, path)
    if not opens(path):
        return found.select("stream_id", "length", F.lit(0).cast("bigint").alias("first"), F.col("length").alias("last"), "content"), 1, True
    n, size = found.agg(F.sum(F.greatest(F.ceil(F.col("length") / split), F.lit(1))), F.sum("length")).first()
    n = tasks_for(spark, n or 1, size or 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint"))
    cuts = found.select("stream_id", "length", F.explode(starts).alias("first"), "content")
    return spread(cuts.select("stream_id", "length", "first", F.least(F.col("first") + split, F.col("length")).alias("last"), "content"), n, "stream_id", "first"), n, False


def file_name(stream_id: str, suffix: str) -> str:
    return f"{quote(stream_id, safe='')}.{suffix}"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: bytes by file."""

    bytes_of: dict[str, int]


class PieceWriter(DataSourceWriter):
    """Pieces of files (``PIECES``), by any number of tasks, into a folder of this job; the commit moves whole files out of it.

    In local and mounted folders tasks write into the file at each piece's place; elsewhere a run of pieces is an object of its
    own, for ``assemble``. A task that runs again writes the same bytes to the same places. An abort removes the job's folder.
    """

    def __init__(self, options):
        self.folder, self.suffix, self.job = options["path"], options["suffix"], options["job"]
        self.in_place = options["in_place"] == "true"

    @property
    def scratch(self) -> str:
        return scratch_folder(self.folder, self.job)

    def write(self, iterator) -> Written:
        written: dict[str, int] = {}
        for name, at, data in gathered(iterator, self.suffix):
            written[name] = written.get(name, 0) + len(data)
            if self.in_place:
                _, inner = located(f"{self.scratch}/{name}")
                handle = os.open(inner, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    view, done = memoryview(data), 0
                    while done < len(data):
                        done += os.pwrite(handle, view[done:], at + done)
                    if not data:  # an empty file is a file
                        os.utime(handle)
                finally:
                    os.close(handle)
            else:
                system, inner = located(f"{self.scratch}/{name}/{at:020d}")
                system.create_dir(inner.rpartition("/")[0])
                with system.open_output_stream(inner) as out:
                    out.write(data)
        return Written(written)

    def commit(self, messages) -> None:
        if not self.in_place:
            return
        total: dict[str, int] = {}
        for m in messages:
            for name, n in m.bytes_of.items() if m is not None else ():
                total[name] = total.get(name, 0) + n
        system, inner = located(self.scratch)
        for name, n in total.items():
            size = system.get_file_info(f"{inner}/{name}").size
            if size != n:
                raise InvalidState(f"the pieces of {name} do not fill it: {n} bytes of {size}")
        publish(self.folder, self.job, total)

    def abort(self, messages) -> None:
        remove(self.scratch)


class PieceSink(DataSource):
    """``df.write.format("tidewell-files")`` of rows (stream_id, at, data); used by ``write_pieces``."""

    @classmethod
    def name(cls):
        return "tidewell-files"

    def writer(self, schema, overwrite):
        return PieceWriter(self.options)


def scratch_folder(folder: str, job: str) -> str:
    return f"{folder}/_tidewell-{job}"


def remove(folder: str) -> None:
    system, inner = located(folder)
    if system.get_file_info(inner).type != arrow_fs.FileType.NotFound:
        system.delete_dir(inner)


def publish(folder: str, job: str, names) -> None:
    """Move the job's whole files to where they are looked for."""
    system, inner = located(folder)
    scratch = located(scratch_folder(folder, job))[1]
    for name in names:
        system.move(f"{scratch}/{name}", f"{inner}/{name}")
    system.delete_dir(scratch)


def gathered(rows: Iterator, suffix: str) -> Iterator[tuple[str, int, bytes]]:
    """File, place and bytes of runs of pieces that follow one another."""
    name, first, parts, size = None, 0, [], 0
    for stream_id, at, data in rows:
        own = file_name(stream_id, suffix)
        if name is not None and (own != name or at != first + size or size >= BUFFER):
            yield name, first, b"".join(parts)
            name = None
        if name is None:
            name, first, parts, size = own, at, [], 0
        parts.append(bytes(data))
        size += len(data)
    if name is not None:
        yield name, first, b"".join(parts)


def assemble(spark: SparkSession, folder: str, job: str) -> None:
    """Put the objects of each file together, in order, a file a task and a buffer at a time; then publish."""
    system, inner = located(scratch_folder(folder, job))
    found = system.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    blocks = [(f.path, f.size) for f in found if f.type == arrow_fs.FileType.File]
    names = sorted({path.split("/")[-2] for path, _ in blocks})
    scratch = scratch_folder(folder, job)

    def run(batches):
        for pdf in batches:
            for name in pdf["name"]:
                place, at = located(f"{scratch}/{name}")
                parts = sorted((f.path for f in place.get_file_info(arrow_fs.FileSelector(at)) if f.is_file))
                end = 0
                with place.open_output_stream(f"{at}.whole") as out:
                    for part in parts:
                        if int(part.rpartition("/")[2]) != end:
                            raise InvalidState(f"the pieces of {name} do not fill it")
                        with place.open_input_stream(part) as part_in:
                            while data := part_in.read(BUFFER):
                                out.write(data)
                                end += len(data)
                yield pd.DataFrame({"bytes": [end]})

    try:
        done = spread(spark.createDataFrame([(n,) for n in names], "name string"), len(names), "name")
        done.mapInPandas(run, "bytes bigint").write.format("noop").mode("overwrite").save()
        for name in names:
            system.delete_dir(f"{inner}/{name}")
            system.move(f"{inner}/{name}.whole", f"{inner}/{name}")
        publish(folder, job, names)
    except Exception:
        remove(scratch)
        raise


def write_pieces(pieces: DataFrame, folder: str, suffix: str, in_place: bool | None = None) -> DataFrame:
    """One file a stream in ``folder`` from pieces (stream_id, at, data) that fill it without gaps; (stream_id, file, bytes).

    Many tasks write one file. Files appear when all tasks have ended well; if one fails, nothing is left. ``in_place`` says
    whether tasks can write at any place of a file, by default whether the folder is local or mounted.
    """
    spark = pieces.sparkSession
    system, inner = located(folder)
    if in_place is None:
        in_place = isinstance(system, arrow_fs.LocalFileSystem)
    job = uuid.uuid4().hex
    system.create_dir(f"{inner}/_tidewell-{job}")
    pieces = pieces.select("stream_id", "at", "data")
    spark.dataSource.register(PieceSink)
    writer = pieces.write.format("tidewell-files").mode("append").options(path=folder, suffix=suffix, job=job, in_place=str(in_place).lower())
    try:
        writer.save()
    except Exception:
        remove(scratch_folder(folder, job))
        raise
    if not in_place:
        assemble(spark, folder, job)
    elif system.get_file_info(f"{inner}/_tidewell-{job}").type != arrow_fs.FileType.NotFound:
        remove(scratch_folder(folder, job))  # no rows, so nothing was committed
    name = F.url_encode("stream_id")
    for java, python in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        name = F.replace(name, F.lit(java), F.lit(python))
    name = F.concat(F.lit(f"{folder}/"), name, F.lit(f".{suffix}"))
    return pieces.groupBy("stream_id").agg(F.max(F.col("at") + F.length("data")).alias("bytes")).select("stream_id", name.alias("file"), "bytes")
