"""Small expressions over array columns, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def indices(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def prefix_sums(values: Column) -> Column:
    """For each element the sum of those before it. Sums of chunks come first, so the work stays near linear."""

    def with_values(v: Column) -> Column:
        chunks = F.transform(indices(F.ceil(F.size(v) / CHUNK)), lambda b: total(F.slice(v, b * CHUNK + 1, CHUNK)))
        return let(
            let(chunks, lambda c: F.transform(c, lambda _, b: total(F.slice(c, 1, b)))),
            lambda before: F.transform(
                v,
                lambda _, i: before[F.floor(i / CHUNK).cast("int")]
                + total(F.slice(v, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)),
            ),
        )

    return let(values, with_values)


def prefix_max(values: Column) -> Column:
    """For each element the largest of those before it, -1 for the first; values are not negative."""

    def with_values(v: Column) -> Column:
        chunks = F.transform(indices(F.ceil(F.size(v) / CHUNK)), lambda b: F.array_max(F.slice(v, b * CHUNK + 1, CHUNK)))
        none = F.lit(-1).cast("long")
        return let(
            let(chunks, lambda c: F.transform(c, lambda _, b: F.coalesce(F.array_max(F.slice(c, 1, b)), none))),
            lambda before: F.transform(
                v,
                lambda _, i: F.greatest(
                    before[F.floor(i / CHUNK).cast("int")],
                    F.coalesce(F.array_max(F.slice(v, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)), none),
                ),
            ),
        )

    return let(values, with_values)


def pieces_of(text: Column, spans: Column) -> Column:
    """The text of each span (start, end), in order of their starts. A chunk of spans is cut out of the text at once."""

    def of_chunk(part: Column) -> Column:
        first = part[0]["start"]
        whole = F.substring(text, (first + 1).cast("int"), (F.array_max(F.transform(part, lambda s: s["end"])) - first).cast("int"))
        cut = lambda region: F.transform(part, lambda s: F.substring(region, (s["start"] - first + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        return let(whole, cut)

    def with_spans(v: Column) -> Column:
        return F.flatten(F.transform(indices(F.ceil(F.size(v) / CHUNK)), lambda b: let(F.slice(v, b * CHUNK + 1, CHUNK), of_chunk)))

    return let(spans, with_spans)


def chunked(spans: Column) -> Column:
    """Chunks of spans (start, end) with the range that each covers, for ``meets``."""

    def chunk(part: Column) -> Column:
        return F.struct(part.alias("part"), F.array_min(F.transform(part, lambda s: s["start"])).alias("low"), F.array_max(F.transform(part, lambda s: s["end"])).alias("high"))

    return let(spans, lambda v: F.transform(indices(F.ceil(F.size(v) / CHUNK)), lambda b: let(F.slice(v, b * CHUNK + 1, CHUNK), chunk)))


def meets(chunks: Column, span: Column) -> Column:
    """Whether ``span`` overlaps one of the ``chunked`` spans."""
    over = lambda a, low, high: (a[low] < span["end"]) & (span["start"] < a[high])
    return F.exists(chunks, lambda c: over(c, "low", "high") & F.exists(c["part"], lambda b: over(b, "start", "end")))
