"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, held_out

BUCKETS = 1 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text, label, fold (0 to 9, by id): labelled documents outside the held-out fifth, ``most`` at most.

    A document with several label rows takes the largest; null labels and ids are left out. The sample is
    taken by the id's hash, so it is the same whenever it is taken. Of an id's repeated rows the one of the
    smallest text hash is taken, so that ids bound the rows as well. The draw's aim lies four standard deviations
    under ``most``, or more, so it goes beyond with a chance of 3e-5 at most.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("draw", F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(BUCKETS)))
    n = known.count()
    if n > most:
        known = known.where(F.col("draw") < int(BUCKETS * min(0.97, max(0.1, 1 - 4 / most**0.5)) * most / n))
    known = known.withColumn("fold", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10))).cast("int")).drop("draw")
    # at most ``most`` rows of three numbers, so the documents need no shuffle
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("t")).join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id", "label", "fold").agg(F.min("t").alias("t"))
    return cut(found.select("t.text", "label", "fold"))
