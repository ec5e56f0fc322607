"""Document fingerprints: bottom-k sketches of shingle hashes (operator 3), in DataFrame functions only.

A text's words (lower case, split at white space) give shingles of five words; a shorter text is one
shingle. Each word is hashed once, a shingle's hash is the hash of its words' hashes, and the sketch is
the ``K`` smallest distinct hashes. The K smallest of the union of two sketches are the sketch of the
union of their shingles, so sketches of parts merge, and two sketches estimate resemblance, containment
and the number of distinct shingles.

To pair each document with the next one, rows are ordered by id, text hash and place in the input. One row in
``DOCS_A_RANGE``, drawn by its hash, heads a range, however many share an id; nothing but these heads is sorted as a
whole. Texts move once, each to its range, and the head of a range also to the range before it.

Defined results: a null text is the empty text, whose sketch is empty. Two empty sketches are alike (1),
an empty and another are not (0). Rows with equal ids are ordered by their text's hash; null ids come
last. Further columns of the input are ignored. The input is read twice, so its rows must keep their places (tables do).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.arrays import indices, let
from tidewell.llm.shared import cut, table

NAME = "op3_fingerprints"
WORDS = 5
K = 256
#: Documents of a range, and of a part (some ranges that are searched together), on the average; parts grow with the square root of the table beyond.
DOCS_A_RANGE, DOCS_A_PART = 5_000, 200_000
#: Ranges expected at most: beyond, they grow. A range is sorted by a task, which spills.
MOST_RANGES = 250_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, ascending."""

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(
            F.slice(h, 1, n - (words - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]),
        )
        return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))

    hashed = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    found = F.coalesce(let(hashed, shingles), F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the share of hash space that k hashes take."""
    share = (F.element_at(s, k).cast("double") + 9223372036854775808.0) / 18446744073709551616.0
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two texts' shingles."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    together = distinct_count(merge(a, b, k), k)
    shared = resemblance(a, b, k) * together
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def shown(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def range_heads(rows: DataFrame) -> DataFrame:
    """part, heads (descending places ``at`` at which the part's ranges begin) of ``rows`` (at), parts in descending order.

    Heads are drawn by the places' hash, and the first place is one. A head is 24 bytes and ``MOST_RANGES`` are expected
    at most, so they are a few MB for any table.
    """
    rows = cut(rows)
    n = rows.count()
    size = max(DOCS_A_RANGE, -(-n // MOST_RANGES))
    first = rows.agg(F.max("at").alias("at")).where("at is not null")
    heads = rows.where(F.pmod(F.xxhash64("at"), F.lit(size)) == 0).union(first).distinct()
    per_part = max(DOCS_A_PART // DOCS_A_RANGE, math.isqrt(n // size) + 1)
    number = F.row_number().over(Window.orderBy(F.col("at").desc())) - 1
    heads = heads.withColumn("part", F.floor(number / per_part).cast("int"))
    return cut(heads.groupBy("part").agg(F.sort_array(F.collect_list("at"), asc=False).alias("heads")))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the text and sketch of the next document by descending id; after the last comes the first."""
    at = F.struct("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    d = docs.withColumn("at", at)
    heads = range_heads(d.select("at"))
    firsts = sorted(heads.select("part", F.col("heads")[0].alias("first"), F.size("heads").alias("n")).collect())  # the square root of MOST_RANGES or so at most
    if not firsts:
        return docs.select("doc_id", "text", sketch(F.col("text")).alias("sketch"), F.col("text").alias("next_text"), sketch(F.col("text")).alias("next_sketch"))
    # ranges are numbered part * 2**32 + number within; before: the last range of the part before, the first part's being the last
    coarse = [(r["part"], r["first"], (firsts[i - 1]["part"] << 32) + firsts[i - 1]["n"] - 1) for i, r in enumerate(firsts)]
    shape = f"array<struct<part:int,first:{d.schema['at'].dataType.simpleString()},before:long>>"
    parts = F.from_json(F.lit(json.dumps([{"part": p, "first": first.asDict(), "before": before} for p, first, before in coarse])), shape)  # a constant
    d = d.withColumn("own", F.element_at(F.filter(parts, lambda c: c["first"] >= F.col("at")), -1))
    d = d.withColumn("part", F.col("own.part")).join(F.broadcast(heads), "part")
    k = F.size(F.filter("heads", lambda h: h >= F.col("at"))) - 1
    d = d.withColumn("k", k.cast("long")).withColumn("range", F.shiftleft(F.col("part").cast("long"), 32) + F.col("k"))
    before = F.when(F.col("k") > 0, F.col("range") - 1).otherwise(F.col("own.before"))
    is_head = F.get("heads", F.col("k").cast("int")) == F.col("at")
    spot = lambda r, g: F.struct(r.alias("range"), F.lit(g).alias("guest"))
    spots = F.when(is_head, F.array(spot(F.col("range"), 0), spot(before, 1))).otherwise(F.array(spot(F.col("range"), 0)))
    d = d.select("doc_id", "text", "at", F.explode(spots).alias("spot")).select("doc_id", "text", "at", "spot.range", "spot.guest")
    d = d.repartition("range").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.col("at").desc())
    d = d.withColumn("next", F.lead(F.struct("text", "sketch")).over(order))
    return d.where("guest = 0").select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses."""
    d = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))

    def result(x: Column) -> Column:
        own, new, after = F.col("sketch"), x["sketch"], F.col("next_sketch")
        return F.struct(
            F.col("doc_id"),
            n.cast("long").alias("n_chars"),
            x["sha"].alias("edited_sha256"),
            shown(own).alias("fingerprint"),
            shown(new).alias("edited_fingerprint"),
            resemblance(own, new).alias("near_edited"),
            resemblance(own, after).alias("near_next"),
            containment(own, new).alias("held_by_edited"),
            distinct_count(own).alias("n_shingles"),
        )

    made = let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), sketch(e).alias("sketch")))
    return d.select(let(made, result).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
