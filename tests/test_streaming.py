import numpy as np
import pytest

from tidewell.functions.levels import Dynamics
from tidewell.operators import processors
from tidewell.streaming import stateful

SCHEMA = "stream_id string, ch int, n bigint, v double"


def stream(spark, folder, x, parts, seed=0):
    """The signal as files that a stream reads one at a time, rows and files' borders shuffled, with the end marked."""
    rng = np.random.default_rng(seed)
    cuts = sorted(rng.choice(np.arange(1, len(x)), parts - 1, replace=False).tolist())
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)])):
        rows = [("s", 0, n, float(x[n])) for n in range(a, b)]
        rows = [rows[k] for k in rng.permutation(len(rows))]
        if b == len(x):
            rows.append(("s", 0, None, None))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    rows = sorted((r.n, r.v) for r in spark.table(name).collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows]


DYNAMICS = Dynamics(1000, attack_time=0.002, release_time=0.004)
CASES = {
    "delay": (lambda s: stateful.delay(s, 3, 1000), lambda s: processors.delay(s, 3, 1000)),
    "fir": (lambda s: stateful.fir(s, [0.5, 0.25, -0.1]), lambda s: processors.fir(s, [0.5, 0.25, -0.1])),
    "iir": (lambda s: stateful.iir(s, [0.5, 0.1], [1.0, -0.5, 0.25]), lambda s: processors.iir(s, [0.5, 0.1], [1.0, -0.5, 0.25])),
    "compressor": (lambda s: stateful.compressor(s, DYNAMICS, precision="f64"), lambda s: processors.compressor(s, DYNAMICS, precision="f64")),
    "resample": (lambda s: stateful.resample(s, 3, 2), lambda s: processors.resample(s, 3, 2)),
    "rechunk": (lambda s: stateful.rechunk(s, 8, "emit"), lambda s: s),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_equals_batch(spark, tmp_path, name):
    x = np.random.default_rng(3).normal(size=50)
    streaming, batch = CASES[name]
    got = run(spark, streaming(stream(spark, str(tmp_path / "in"), x, 3)), tmp_path, f"t_{name}")
    whole = spark.createDataFrame([("s", 0, n, float(v)) for n, v in enumerate(x)], SCHEMA)
    want = [r.v for r in batch(whole).orderBy("n").collect()]
    assert np.allclose(got, want, atol=1e-9) and len(got) == len(want)
