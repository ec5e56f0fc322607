"""A corpus pipeline of five stages, each by one operator of ``tidewell.llm``.

Toxic documents go; recurring lines are dropped (a document of nothing else goes); one document of each
group of near copies stays; secrets are replaced by a mark; what is left is packed into sequences. Every
stage's result is written as Parquet and read again as the next one's documents.

Every stage takes a table of any number of rows, none included, with further columns of any names, which pass
unchanged; each states what null and empty texts, ties and repeated rows give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import op1_line_dedup, op2_toxicity, op4_packing, op8_jaccard_join, op9_secrets
from tidewell.llm.shared import cut, fresh, table

#: Not expressible in SQL: stages fit a classifier, solve a linear program and tokenise.
ORACLE_SQL = None


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic (0.5 or more) go; the others stay as they are.

    Null and empty texts score as no evidence, and so stay unless nearly all labels are toxic. Repeated rows score alike.
    Documents need no label; null ids have none.
    """
    return op2_toxicity.clean(docs, op2_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines but their first occurrence go, and so do documents that consisted of them.

    A null text becomes empty and stays, as do empty ones. First is the smallest id (null ids last), then the text's hash,
    then the line; repeated rows are one document and keep the same lines.
    """
    lines, gone = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    out = op1_line_dedup.dedup(docs, lines, gone)
    out = out.where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    return with_length(out).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id (null ids last), then of the text's hash.

    Repeated rows are copies of each other. Texts without words, null and empty ones included, all stay.
    """
    return op8_jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become a mark. Null texts become empty; repeated rows are treated alike."""
    return with_length(op9_secrets.redact(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences. Null and empty texts are their closing id; repeated rows are packed each."""
    with open(public_tokenizers.path(op4_packing.TOKENIZER), encoding="utf-8") as f:
        return op4_packing.pack(op4_packing.pieces(docs, f.read(), added=True))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
