"""Running a streaming form over a table: its rows become files, a stream reads them, and a table holds what came out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a micro-batch, and the files in which they come.
ROWS_A_BATCH, FILES_A_BATCH = 2_000_000, 4


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it, as the cluster names it; a local one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` as a table, so that what is made from them several times is computed once."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(f"{folder}/rows")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def through_stream(samples: DataFrame, transform: Callable[[DataFrame], DataFrame], files: int = 8) -> DataFrame:
    """``transform`` applied to ``samples`` as a stream of micro-batches; a last row without position ends each channel."""
    rows = kept(samples.select("stream_id", "ch", "n", "v"))
    ends = rows.select("stream_id", "ch").distinct().select("stream_id", "ch", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
    return run_stream(rows, transform, "n", files, then=ends).select("stream_id", "ch", "n", "v")


def run_stream(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], by: str, files: int = 8, then: DataFrame | None = None) -> DataFrame:
    """``transform`` applied to ``rows`` as a stream of micro-batches in the order of ``by`` (of ``epoch`` first, where there is one); its output as a table.

    There are as many batches as the rows need (``ROWS_A_BATCH``), ``files`` files at least in all, and a batch comes when the one before it has
    been seen. So a batch, and what waits in the state for items before it, stays as large as it is, whatever the table. Rows of ``then`` come in
    the batch after the last one that has rows of their stream and epoch.
    """
    spark = rows.sparkSession
    folder, schema = shared_folder(spark), rows.schema
    order = [c for c in ("epoch", by) if c in rows.columns]
    count = max(-(-files // FILES_A_BATCH), -(-rows.count() // ROWS_A_BATCH))
    batch = F.floor(F.spark_partition_id() / FILES_A_BATCH).cast("int")
    rows.repartitionByRange(count * FILES_A_BATCH, *order).withColumn("batch_", batch).write.partitionBy("batch_").parquet(f"{folder}/staged")
    staged = spark.read.schema(StructType([*schema, StructField("batch_", IntegerType())])).parquet(f"{folder}/staged")
    if then is not None:
        keys = [c for c in ("stream_id", "ch", "epoch") if c in rows.columns]
        last = staged.groupBy(*keys).agg((F.max("batch_") + 1).alias("batch_"))
        then.join(last, keys).select(*rows.columns, "batch_").repartition(FILES_A_BATCH, "batch_").write.partitionBy("batch_").parquet(f"{folder}/then")
        staged = staged.unionByName(spark.read.schema(staged.schema).parquet(f"{folder}/then"))
        count += 1
    staged.where("false").drop("batch_").write.parquet(f"{folder}/in")
    out = transform(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    sink = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query = sink.start()
    try:
        for i in range(count):
            staged.where(F.col("batch_") == i).drop("batch_").write.mode("append").parquet(f"{folder}/in")
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
