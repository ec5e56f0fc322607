"""Positions, frames and count windows.

Nothing here keeps a whole stream in one task: positions and running values come from those of ranges and what lies within a
range, count windows are groups of a fixed size, and neighbours across block borders are copied (a halo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.model import AudioFormat, InvalidData

#: Quantile ranges of a position, and rows aimed at in each of the equal parts of such a range.
RANGES, RANGE_ROWS = 64, 20_000
#: Frames of a stream over which running values are taken at once.
RUN = 4_096
BLOCK = 1 << 16


def number_rows(df: DataFrame, keys: list[str], order: list[str], by: Column, out: str = "n") -> DataFrame:
    """Positions 0, 1, ... within ``keys`` by ``order``, whose first column rises with the number ``by``.

    ``by`` is cut at quantiles, so that outliers have ranges of their own, and each range into equal parts, more of them
    the more rows there are. Counts of parts (few rows) give each its first position, and rows are numbered within their
    part. So a key of a third of all rows is spread over many tasks. The quantiles are taken when the plan is built.
    """
    df = df.withColumn("by_", by.cast("double"))
    shares = [i / RANGES for i in range(RANGES + 1)]
    n, bounds = df.agg(F.count("by_"), F.percentile_approx("by_", shares, 10_000)).first()
    bounds = sorted(set(bounds or [0.0]))
    parts = max(1, n // (RANGES * RANGE_ROWS))
    lows, spans = F.array(*map(F.lit, bounds)), F.array(*[F.lit(max(b - a, 1e-300)) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1.0])])
    df = df.withColumn("range_", F.greatest(F.size(F.filter(lows, lambda b: b <= F.col("by_"))), F.lit(1)) - 1)
    inside = F.floor((F.col("by_") - lows[F.col("range_")]) / spans[F.col("range_")] * parts)
    df = df.withColumn("part_", F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)), F.lit(-1)).cast("int"))
    counts = df.groupBy(*keys, "range_", "part_").agg(F.count(F.lit(1)).alias("count_"))
    earlier = Window.partitionBy(*keys).orderBy("range_", "part_")
    firsts = counts.withColumn("first_", F.sum("count_").over(earlier) - F.col("count_")).drop("count_")
    within = Window.partitionBy(*keys, "range_", "part_").orderBy(*order)
    numbered = df.withColumn("place_", F.row_number().over(within) - 1)
    numbered = numbered.join(firsts, [*keys, "range_", "part_"]).withColumn(out, F.col("first_") + F.col("place_"))
    return numbered.drop("by_", "range_", "part_", "place_", "first_")


def running(frames: DataFrame, value: Column, how: str, out: str) -> DataFrame:
    """``out``: the sum or maximum (``how``) of ``value`` over a stream's frames so far, by ``seq``.

    Runs of frames come first: each run's own value (a row a run), and what the runs before it give. So no task holds
    a whole stream.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}[how]
    d = frames.withColumn("run_", F.floor(F.col("seq") / RUN)).withColumn("value_", value)
    runs = d.groupBy("stream_id", "run_").agg(f("value_").alias("own_"))
    earlier = Window.partitionBy("stream_id").orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before_", f("own_").over(earlier)).drop("own_")
    within = Window.partitionBy("stream_id", "run_").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("here_", f("value_").over(within)).join(runs, ["stream_id", "run_"])
    return d.withColumn(out, both(F.col("before_"), F.col("here_"))).drop("run_", "value_", "here_", "before_")


def totals_before(rows: DataFrame, values: dict[str, Column], last: str | None = None) -> DataFrame:
    """``rows`` with the sums of ``values`` (by name) over the stream's earlier rows, by ``seq``; ``last``: a name for whether a row ends its stream.

    All sums are made in one pass over runs of rows, a row a run, and one within each run; the rows move once.
    """
    d = rows.withColumn("run_", F.floor(F.col("seq") / RUN)).withColumns({f"{k}_own_": v.cast("bigint") for k, v in values.items()})
    runs = d.groupBy("stream_id", "run_").agg(F.count(F.lit(1)).alias("rows_"), *[F.sum(f"{k}_own_").alias(f"{k}_all_") for k in values])
    along = Window.partitionBy("stream_id").orderBy("run_")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("stream_id", "run_", F.lead("run_").over(along).isNull().alias("end_"), *[F.coalesce(F.sum(f"{k}_all_").over(earlier), F.lit(0)).alias(f"{k}_before_") for k in values])
    order = Window.partitionBy("stream_id", "run_").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"{k}_here_": F.coalesce(F.sum(f"{k}_own_").over(so_far), F.lit(0)) for k in values})
    if last:
        d = d.withColumn("more_", F.lead("seq").over(order).isNotNull())
    d = d.join(runs, ["stream_id", "run_"])
    out = d.withColumns({k: F.col(f"{k}_before_") + F.col(f"{k}_here_") for k in values})
    return out.select(*rows.columns, *values, *([(F.col("end_") & ~F.col("more_")).alias(last)] if last else []))


def with_halo(samples: DataFrame, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Samples in blocks of positions; ``own_`` is false on copies that only lend their values to the neighbour block."""
    block = max(block, before, after)
    n = F.col("n")
    at = F.floor(n / block)
    blocks = F.array(F.struct(at.alias("block_"), F.lit(True).alias("own_")))
    if before:
        to_next = F.when(n >= (at + 1) * block - before, F.array(F.struct((at + 1).alias("block_"), F.lit(False).alias("own_"))))
        blocks = F.concat(blocks, F.coalesce(to_next, F.array().cast("array<struct<block_:bigint,own_:boolean>>")))
    if after:
        to_last = F.when((n < at * block + after) & (at > 0), F.array(F.struct((at - 1).alias("block_"), F.lit(False).alias("own_"))))
        blocks = F.concat(blocks, F.coalesce(to_last, F.array().cast("array<struct<block_:bigint,own_:boolean>>")))
    return samples.withColumn("b_", F.explode(blocks)).select(*samples.columns, "b_.block_", "b_.own_")


def frames_to_samples(frames: DataFrame) -> DataFrame:
    """Samples of frames; the position is the number of samples in the stream's earlier frames plus the place within."""
    first = running(frames.select("stream_id", "seq", "nb_samples", "samples"), F.col("nb_samples").cast("bigint"), "sum", "end_")
    first = first.withColumn("first_", F.col("end_") - F.col("nb_samples"))
    planes = first.select("stream_id", "first_", F.posexplode("samples").alias("ch", "plane"))
    return planes.select("stream_id", "ch", "first_", F.posexplode("plane").alias("i", "v")).select(
        "stream_id", "ch", (F.col("first_") + F.col("i")).cast("bigint").alias("n"), "v"
    )


def rechunk(samples: DataFrame, size: int, tail: str = "emit") -> DataFrame:
    """stream_id, ch, chunk, first (position), values: count windows of ``size`` samples.

    ``tail`` says what becomes of a short last window: ``emit`` as it is, ``drop``, or ``pad`` with zeros.
    """
    if size < 1 or tail not in ("emit", "drop", "pad"):
        raise InvalidData("a window holds one sample at least, and its tail is emitted, dropped or padded")
    got = samples.groupBy("stream_id", "ch", F.floor(F.col("n") / size).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("n", "v"))).alias("s")
    )
    got = got.select("stream_id", "ch", "chunk", F.col("s")[0]["n"].alias("first"), F.transform("s", lambda x: x["v"]).alias("values"))
    short = size - F.size("values")
    if tail == "drop":
        return got.where(short == 0)
    if tail == "pad":
        return got.withColumn("values", F.concat("values", F.array_repeat(F.lit(0.0), short)))
    return got


def samples_to_frames(samples: DataFrame, fmt: AudioFormat, size: int, tail: str = "emit", first_pts: int | None = 0) -> DataFrame:
    """Frames of ``size`` samples of all channels; time stamps count samples from ``first_pts`` (None: no time stamps)."""
    chunks = rechunk(samples, size, tail)
    planes = chunks.groupBy("stream_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("ch", "values"))).alias("planes"), F.min("first").alias("first"), F.max(F.size("values")).alias("nb_samples")
    )
    pts = F.lit(None).cast("bigint") if first_pts is None else F.col("first") + first_pts
    base = F.struct(F.lit(1).alias("num"), F.lit(fmt.sample_rate).alias("den"))
    return planes.select(
        "stream_id",
        F.col("chunk").cast("bigint").alias("seq"),
        pts.cast("bigint").alias("pts"),
        base.alias("time_base"),
        fmt.column().alias("format"),
        "nb_samples",
        F.transform("planes", lambda p: p["values"]).alias("samples"),
    )


def pts_breaks(frames: DataFrame, tasks: int | None = None) -> DataFrame:
    """``frames`` with ``continues``: whether the time stamp is where the frame before it ended (the first: whether it has one).

    ``tasks``: how many share the runs of frames, where it is not the session's number of shuffle partitions.
    """
    # the frame before is in the same run, or the last of the runs before
    d = frames.withColumn("run_", F.floor(F.col("seq") / RUN)).withColumn("ends_", F.struct("seq", (F.col("pts") + F.col("nb_samples")).alias("at")))
    if tasks is not None:
        d = d.repartition(tasks, "stream_id", "run_")
    runs = d.groupBy("stream_id", "run_").agg(F.max("ends_").alias("own_"))
    earlier = Window.partitionBy("stream_id").orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before_", F.max("own_").over(earlier)).drop("own_")
    d = d.withColumn("last_", F.lag("ends_").over(Window.partitionBy("stream_id", "run_").orderBy("seq"))).join(runs, ["stream_id", "run_"])
    d = d.withColumn("last_", F.coalesce("last_", "before_"))
    fine = F.when(F.col("last_").isNull(), F.col("pts").isNotNull()).otherwise(F.coalesce(F.col("pts") == F.col("last_.at"), F.lit(False)))
    return d.withColumn("continues", fine).drop("run_", "ends_", "last_", "before_")


def chunk_pts(frames: DataFrame, size: int) -> DataFrame:
    """stream_id, chunk, pts of the count windows that a buffer makes of frames as they come.

    The buffer trusts time stamps from a frame on that comes when it is empty and trusts none, and for as long as they continue; a frame that
    does not continue ends the trust, also where the buffer is empty. So trust is an automaton of two states: a frame keeps it (it
    continues), makes it (it comes into the empty buffer), does both, or neither, which leaves it, turns it over, sets or clears it. The state
    after a frame is that of the last frame that sets or clears, turned over as often as frames since then do.
    All is made in runs of frames, which move once; a row a run says what came before.
    """
    keys = ["stream_id", "run_"]
    order = Window.partitionBy(*keys).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy("stream_id").orderBy("run_")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    d = frames.select("stream_id", "seq", "pts", F.col("nb_samples").cast("bigint").alias("nb_"), F.floor(F.col("seq") / RUN).alias("run_"))
    d = d.withColumn("here_", F.sum("nb_").over(so_far) - F.col("nb_")).withColumn("own_", F.col("pts") - F.col("here_"))
    runs = d.groupBy(*keys).agg(F.sum("nb_").alias("all_"), F.max(F.struct("seq", "own_"))["own_"].alias("last_"))
    runs = runs.withColumn("before_", F.coalesce(F.sum("all_").over(earlier), F.lit(0)))
    runs = runs.select(*keys, "before_", F.lag(F.col("last_") - F.col("before_")).over(along).alias("ahead_"))
    d = d.join(runs, keys).withColumn("start_", F.col("before_") + F.col("here_")).withColumn("base_", F.col("pts") - F.col("start_"))
    behind = F.when(F.row_number().over(order) == 1, F.col("ahead_")).otherwise(F.lag("base_").over(order))
    keeps = F.coalesce(F.col("base_") == behind, F.lit(False))
    makes = F.col("base_").isNotNull() & (F.col("start_") % size == 0)
    d = d.withColumn("keeps_", keeps).withColumn("makes_", makes)
    d = d.withColumn("turns_", F.sum(F.when(~F.col("keeps_") & F.col("makes_"), 1).otherwise(0)).over(so_far))
    sure = F.when(F.col("keeps_") == F.col("makes_"), F.struct("seq", F.col("keeps_").alias("on"), "turns_"))
    d = d.withColumn("sure_", F.max(sure).over(so_far))
    # the state at a run's end, given the one at its start, is all that the next runs need
    ends = d.groupBy(*keys).agg(F.max("sure_").alias("sure_"), F.max("turns_").alias("turns_"))
    ends = ends.withColumn("sum_", F.sum("turns_").over(along))
    sure = F.when(F.col("sure_").isNotNull(), F.struct("run_", F.col("sure_.on").alias("on"), (F.col("sum_") - F.col("turns_") + F.col("sure_.turns_")).alias("at")))
    ends = ends.withColumn("set_", F.max(sure).over(earlier)).withColumn("turned_", F.col("sum_") - F.col("turns_") - F.coalesce("set_.at", F.lit(0)))
    odd = lambda n: n % 2 == 1
    begins = ends.select(*keys, (F.coalesce("set_.on", F.lit(False)) != odd(F.col("turned_"))).alias("in_"))
    since = F.col("turns_") - F.coalesce("sure_.turns_", F.lit(0))
    f = d.join(begins, keys).withColumn("trusted_", F.coalesce("sure_.on", "in_") != odd(since))
    # a window is popped when the frame that completes it has been pushed
    first_full, full = F.floor(F.col("start_") / size), F.floor((F.col("start_") + F.col("nb_")) / size)
    made = f.where(full > first_full).select("stream_id", F.explode(F.sequence(first_full, full - 1)).alias("chunk"), "trusted_", "base_")
    return made.select("stream_id", "chunk", F.when(F.col("trusted_"), F.col("base_") + F.col("chunk") * size).cast("bigint").alias("pts"))


def prepend(first: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows of ``first`` before those of ``rest``: positions of ``rest`` move up by the length of ``first`` in each stream."""
    lengths = first.groupBy("stream_id").agg((F.max("seq") + 1).alias("shift_"))
    moved = rest.join(lengths, "stream_id", "left").withColumn("seq", F.col("seq") + F.coalesce("shift_", F.lit(0))).drop("shift_")
    return first.unionByName(moved)
