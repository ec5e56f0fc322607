import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.functions import levels


def test_levels_of_silence_and_negative_values(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, 10.0), (3, None)], "i int, v double")
    out = rows.select("i", levels.lin_to_db(F.col("v")).alias("db")).orderBy("i")
    db = [r.db for r in out.collect()]
    assert db[0] == -math.inf and math.isnan(db[1]) and abs(db[2] - 20) < 1e-12 and db[3] is None
    assert out.select(levels.db_to_lin(F.col("db")).alias("v")).first().v == 0.0


def table(spark, tmp_path, values):
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i), "click", v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, want", [("db_roundtrip", [0.0, 5.0]), ("knee_curve", [-math.inf, round(20 * math.log10(5 / 490.02) + 30, 6)])])
def test_silence_has_a_level(spark, tmp_path, name, want):
    got = catalog.queries()[name](spark, table(spark, tmp_path, [0.0, 5.0])).orderBy("n").collect()
    assert [r.v for r in got] == want


def test_wav_round_trip_keeps_what_is_louder_than_one(spark, tmp_path):
    values = [0.0, 250.0, 500.0, 520.16, -560.21, 1300.07, -1499.99]
    got = catalog.queries()["wav_file_roundtrip"](spark, table(spark, tmp_path, values)).orderBy("n").collect()
    half_up = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    assert [r.v for r in got] == [round(half_up(v / 500 * 32767) / 32768, 9) for v in values]
