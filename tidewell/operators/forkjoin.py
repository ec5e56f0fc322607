"""Forks into branches, and reducers that join the branches' equal positions.

Branch i's k-th output meets every other branch's k-th output; what one branch has more than another is
dropped. Branches are unions with their number, so a join is one grouped aggregate, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.levels import denormalise, normalise
from tidewell.model import InvalidData

Branch = Callable[[DataFrame], DataFrame]
Reducer = Callable[[list[Column]], Column]


class Pointwise:
    """A branch that maps each value by itself. Branches that all are such are joined without any exchange of rows."""

    def __init__(self, f: Callable[[Column], Column]):
        self.f = f

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("v", self.f(F.col("v")))


def _weights(values: list, weights) -> list:
    if not values:
        raise InvalidData("there is nothing to reduce")
    if weights is None:
        return [1] * len(values)
    if len(weights) != len(values):
        raise InvalidData("a weight for each branch")
    return list(weights)


def total(weights=None) -> Reducer:
    return lambda vs: reduce(lambda a, b: a + b, [v if weights is None else v * w for v, w in zip(vs, _weights(vs, weights))])


def product(weights=None) -> Reducer:
    return lambda vs: reduce(lambda a, b: a * b, [v if weights is None else v * w for v, w in zip(vs, _weights(vs, weights))])


def mean_whole() -> Reducer:
    """Mean of whole numbers, cut toward zero."""
    return lambda vs: _div(total()(vs), len(_weights(vs, None)))


def _div(v: Column, n: int) -> Column:
    return F.when(v < 0, -F.floor(-v / n)).otherwise(F.floor(v / n)).cast("bigint")


def mean() -> Reducer:
    return lambda vs: total()(vs) / len(_weights(vs, None))


def highest() -> Reducer:
    """The largest number; what is no number never wins, and nothing but those gives minus infinity."""
    return lambda vs: F.coalesce(_most(F.greatest, vs), F.lit(float("-inf")))


def lowest() -> Reducer:
    return lambda vs: F.coalesce(_most(F.least, vs), F.lit(float("inf")))


def _most(f, vs: list[Column]) -> Column:
    kept = [F.when(~F.isnan(v.cast("double")), v) for v in vs]
    return f(*kept) if len(kept) > 1 else kept[0]


def joined_text() -> Reducer:
    """Strings, bytes or arrays one after another."""
    return lambda vs: F.concat(*vs)


def exclusive_or() -> Reducer:
    return lambda vs: reduce(lambda a, b: a.bitwiseXOR(b), vs)


def in_domain(reducer: Reducer, sample_type: str) -> Reducer:
    """A reducer of raw samples that works on normalised values."""
    return lambda vs: denormalise(reducer([normalise(v, sample_type) for v in vs]), sample_type)


def fork_join(df: DataFrame, branches: list[Branch], reducer: Reducer, keys: list[str], value: str = "v") -> DataFrame:
    """``keys`` and the reduced ``value`` of the positions that all branches have."""
    if not branches:
        raise InvalidData("a fork needs one branch at least")
    if value == "v" and all(isinstance(b, Pointwise) for b in branches):
        return df.select(*keys, reducer([b.f(F.col(value)) for b in branches]).alias(value))
    many = [b(df).select(*keys, F.col(value).alias("value_"), F.lit(i).alias("branch_")) for i, b in enumerate(branches)]
    all_ = reduce(DataFrame.unionByName, many)
    # each branch gives a position one row at most, so these aggregates hold one value a branch
    columns = [F.max(F.when(F.col("branch_") == i, F.col("value_"))).alias(f"b{i}_") for i in range(len(branches))]
    met = all_.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("count_")).where(F.col("count_") == len(branches))
    return met.select(*keys, reducer([F.col(f"b{i}_") for i in range(len(branches))]).alias(value))


def mix(samples: DataFrame, branches: list[Branch], reducer: Reducer, sample_type: str = "f64") -> DataFrame:
    """Samples of the branches, reduced in the normalised domain of their type."""
    return fork_join(samples, branches, in_domain(reducer, sample_type), ["stream_id", "ch", "n"])


def concat_streams(parts: list[DataFrame]) -> DataFrame:
    """Samples of the parts one after another in each channel. Each part is read for its lengths and for its samples, no more."""
    keys = ["stream_id", "ch"]
    numbered = [p.select(*keys, "n", "v", F.lit(i).alias("part_")) for i, p in enumerate(parts)]
    all_ = reduce(DataFrame.unionByName, numbered)
    # a row for each part of a channel
    lengths = all_.groupBy(*keys, "part_").agg((F.max("n") + 1).alias("length_"))
    shifts = lengths.withColumn("shift_", F.sum("length_").over(Window.partitionBy(*keys).orderBy("part_")) - F.col("length_")).drop("length_")
    return all_.join(shifts, [*keys, "part_"]).select(*keys, (F.col("n") + F.col("shift_")).alias("n"), "v")


def concat_packets(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of all branches of a packet in the order of ``branch``; timing is dropped but the time base."""
    got = packets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("branch", "data"))).alias("parts"), F.min("time_base").alias("time_base"), F.max("time_base").alias("other_"))
    same = F.when(F.col("time_base") == F.col("other_"), F.col("time_base")).otherwise(F.raise_error("packets differ in time base"))
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return got.select(*keys, data.alias("data"), same.alias("time_base"))


def xor_packets(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Byte-wise exclusive or of the branches of a packet, which must be of one length and time base."""
    got = packets.groupBy(*keys).agg(F.collect_list("data").alias("parts"), F.min(F.length("data")).alias("short_"), F.max(F.length("data")).alias("long_"))

    @F.pandas_udf("binary")
    def combined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda own: np.bitwise_xor.reduce([np.frombuffer(p, np.uint8) for p in own]).tobytes())

    same = F.col("short_") == F.col("long_")
    met = got.withColumn("parts", F.when(same, F.col("parts")).otherwise(F.raise_error("packets differ in length")))
    return met.select(*keys, combined("parts").alias("data"))
