"""Filter interaction audit: what five filters remove of each part, alone and in every order (operator 11).

A document fails a set of filters, its mask. A part's documents are counted by mask (32 counts at most), and all else
comes from these counts. With x_i the share of filter i that is switched on, the number of removed documents is the
multilinear polynomial

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)) = sum over sets T of a(T) * product over i in T of x_i

with a(T) = (-1)^(|T| + 1) times the number of documents whose mask holds all of T. Its corners say what any set of filters
removes, so the survivors of an order's steps are differences of corners. The Shapley value of filter i is the integral
of its partial derivative along the diagonal, the sum of a(T) / |T| over the sets T that hold i, in exact rationals;
times 120 it is a whole number, the removals of the filter summed over all orders. Good and toxic documents have polynomials of their own.

Failures (words: runs of anything but the six ASCII white spaces): A under 200 words; B under half of the words distinct; C over 2 %
of the code points in A-Z; D one of ``#$%&*|``; E the text is that of a smaller id.

Scale: a document becomes a row of its id, a 32-byte digest of its text, its part, its mask and its labels; rows of equal
values are counted before they move, so groups of copies and repeated ids cost a row each. One join by id brings the
labels, one by digest and id says which rows are a text's first; neither key has many rows. A part is a group of 32
counts and 600 result rows, made where the group is; nothing reaches the driver.

Defined results: a null text is empty (it fails A alone, and E by another empty text); a null source is the part ''; a null id has no labels
and no order, so it fails E never and lets no other fail; equal rows (id and text) are documents each, and none is smaller than
the other; of several label rows of an id the largest counts; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, table

NAME = "op11_filter_audit"
FILTERS = "ABCDE"
LEAST_WORDS = 200
#: A word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def own_mask(text: Column) -> Column:
    """Bits 0 to 3: the failures that a text has by itself."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    few = lambda n: F.when(n < LEAST_WORDS, 1).otherwise(0)
    same = lambda n, distinct: F.when(100 * distinct < 50 * n, 2).otherwise(0)
    # the words are named once, so that they are split once
    of_words = F.transform(F.array(words), lambda w: few(F.size(w)) + same(F.size(w), F.size(F.array_distinct(w))))[0]
    n = F.length(text)
    capitals = n - F.length(F.translate(text, CAPITALS, ""))
    return of_words + F.when(100 * capitals > 2 * n, 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i fails), n, good, toxic: the documents of each part and mask."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        own_mask(text).alias("mask"),
    )
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    d = d.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    rows = cut(d.groupBy("digest", "id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = rows.join(first, ["digest", "id"], "left")
    copy = F.when(F.col("id").isNull() | F.col("first").isNotNull(), 0).otherwise(16)
    return told.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


class Removals:
    """The removal polynomial of counts by mask."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters = filters
        self.total = sum(counts.values())
        self.coefficients = {}
        for t in range(1, 1 << filters):
            holding = sum(n for m, n in counts.items() if m & t == t)
            if holding:
                self.coefficients[t] = holding if t.bit_count() % 2 else -holding

    def corner(self, on: int) -> int:
        """The documents that the filters ``on`` remove together."""
        return sum(a for t, a in self.coefficients.items() if t & on == t)

    def partial_integral(self, i: int) -> Fraction:
        """The partial derivative by x_i, integrated along x_1 = ... = x_n = t for t from 0 to 1."""
        return sum((Fraction(a, t.bit_count()) for t, a in self.coefficients.items() if t >> i & 1), Fraction(0))

    def over_orders(self, i: int) -> int:
        """What filter i removes, summed over all orders."""
        value = self.partial_integral(i) * factorial(self.filters)
        assert value.denominator == 1
        return value.numerator


def audit_rows(part: str, counts: list) -> Iterator[tuple]:
    """A part's rows: every order and step. ``counts``: (mask, n, good, toxic)."""
    f, good, toxic = (Removals({c["mask"]: c[k] for c in counts}) for k in ("n", "good", "toxic"))
    k = f.filters
    everything = (1 << k) - 1
    removed, lost_good, lost_toxic = ([p.corner(s) for s in range(1 << k)] for p in (f, good, toxic))
    shapley = [f.over_orders(i) for i in range(k)]
    for order in permutations(range(k)):
        on = 0
        name = "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            before, on = on, on | 1 << i
            here = removed[on] - removed[before]
            yield (
                part, name, step, f.total - removed[on], here, removed[1 << i] - here, removed[everything] - removed[everything ^ 1 << i],
                lost_good[on] - lost_good[before], lost_toxic[on] - lost_toxic[before], shapley[i],
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order and step; see the module."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 counts at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OUT.split(", ")]
        for pdf in batches:
            for part, counts in zip(pdf["part"], pdf["counts"]):
                yield pd.DataFrame(audit_rows(part, counts), columns=columns)

    return parts.mapInPandas(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Documents are counted order by order and step by step: one is removed by the first filter of the order that it fails.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
w AS (SELECT d.doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
 || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
 || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < w.doc_id THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT '' AS p UNION ALL SELECT p || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(p, l)),
s AS (SELECT p, k AS step, p[k:k] AS l, p[1:k-1] AS before FROM (SELECT p, unnest(range(1, 6)) AS k FROM o WHERE length(p) = 5)),
t AS (SELECT part, p AS filter_order, step, l, n, good, toxic, contains(fails, l) AS own, length(translate(before, fails, '')) < length(before) AS gone, fails = l AS alone FROM c, s),
r AS (SELECT part, filter_order, step, l, sum(CASE WHEN gone OR own THEN 0 ELSE n END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM t GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM r"""
