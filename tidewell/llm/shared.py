"""Helpers that several operators share: lineage cuts, table reading and id hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key with over one in so many rows is hot: there are at most so many hot keys, whatever the table's size.
HOT = 10_000
#: Rows of a batch that a Python step takes at once: what it makes of them (lists of lines, words or tokens) is a multiple of their size.
PORTION = 1_000


def portions(batches, rows: int = PORTION):
    """The rows of ``batches`` (pandas frames), at most ``rows`` at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only in local mode where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidewell_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; nothing that is still to run may read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tidewell_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added, so that no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(left: DataFrame, on: list[str], right: DataFrame | None = None, sizes: str | None = None) -> DataFrame | None:
    """The keys of ``left`` with over one in ``HOT`` of its rows, to be broadcast; None without any.

    Where ``right`` has a row for each key that matters, with its number of rows in ``left`` as column ``sizes``,
    they are not counted again.
    """
    spark = left.sparkSession
    if sizes is None:
        n = fresh(left, "n")
        counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    else:
        n, counted = sizes, right.select(*on, sizes)
    total = left.count()
    rows = counted.where((F.col(n) * HOT > total) & (F.col(n) > 1)).dropna(subset=on).drop(n).collect()  # fewer than HOT rows
    return F.broadcast(spark.createDataFrame(rows, left.select(*on).schema)) if rows else None


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", sizes: str | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row a key at most, and fewer than ``HOT`` of hot keys.

    Rows of hot keys stay where they are, as the few right rows of these keys are broadcast, and so do rows of
    null keys; the others are shuffled by key. ``left`` and ``right`` are read more than once: cut them before.
    ``sizes`` names the column of ``right``, if any, that holds a key's number of rows in ``left``.
    """
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    hot = hot_keys(left, on, right, sizes)
    if hot is None:
        some = left.where(~none).join(right, on, how)
    else:
        some = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
        some = some.unionByName(left.where(~none).join(hot, on, "left_anti").join(right, on, how))
    return some if how == "inner" else some.unionByName(left.where(none), allowMissingColumns=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
