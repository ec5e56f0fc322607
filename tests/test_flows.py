import random

import numpy as np
import pandas as pd
import pytest

from tidewell.model import FRAMES, InvalidData
from tidewell.operators import forkjoin, framing, processors
from tidewell.streaming import batches, flows, stateful


def fed(spark, tmp_path, rows, schema, parts, transform, name, seed=0):
    """Rows as files in any order, a file a batch."""
    rnd = random.Random(seed)
    rows = rows[:]
    rnd.shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    q = transform(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.read.parquet(f"{tmp_path}/{name}/out").collect()


def samples_of(x, epochs=1, control="end"):
    rows = [("s", c, e, n, float(v) * (c + 1) + e, None, None) for c in range(2) for e in range(epochs) for n, v in enumerate(x)]
    last = epochs - 1
    return rows + [("s", c, e, None, None, "end" if e == last else control, len(x)) for c in range(2) for e in range(epochs)]


def test_streaming_fork_equals_batch_join_with_unequal_delays(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=60)
    steps = [[stateful.passing()], [stateful.delaying(5, 1000), stateful.convolving([0.5, 0.25])], [stateful.resampling(3, 2)], [stateful.mapping(lambda v: v * -2.0), stateful.windowing(8, "drop")]]
    branches = [processors.identity, lambda s: processors.fir(processors.delay(s, 5, 1000), [0.5, 0.25]), lambda s: processors.resample(s, 3, 2), lambda s: processors.gain(s, -2.0).where("n < 56")]
    reducer = forkjoin.total([1.0, 2.0, 3.0, 4.0])
    got = fed(spark, tmp_path, samples_of(x), flows.SAMPLE_FLOW, 5, lambda s: flows.fork_join(s, steps, reducer), "fork")
    whole = spark.createDataFrame([r[:2] + r[3:5] for r in samples_of(x) if r[5] is None], "stream_id string, ch int, n bigint, v double")
    want = {(r.ch, r.n): r.v for r in forkjoin.mix(whole, branches, reducer).collect()}
    assert len(got) == len(want) == 80 and all(abs(want[r.ch, r.n] - r.v) < 1e-9 for r in got)
    with pytest.raises(InvalidData):
        flows.fork_join(None, [], reducer)


@pytest.mark.parametrize("control", ["drain", "discard"])
def test_resets_drain_or_discard(spark, tmp_path, control):
    x = list(range(1, 11))
    rows = samples_of(x, 3, control)
    if control == "discard":  # at once: so the control rows come last, and late items of an epoch that is over are dropped
        rows = [r for r in rows if r[2] != 1 or r[3] is None or r[3] < 4] + [("s", c, 0, 10, 99.0, None, None) for c in range(2)]
    steps = [stateful.delaying(3, 1000), stateful.convolving([1.0, 1.0])]
    got = {}
    seed = {"drain": 1, "discard": 2}[control]
    parts = [rows] if control == "drain" else [[r for r in rows if r[5] is None and r[3] < 10], [r for r in rows if r[5] is not None], [r for r in rows if r[3] == 10]]
    if control == "drain":
        out = fed(spark, tmp_path, rows, flows.SAMPLE_FLOW, 4, lambda s: flows.chain(s, steps), control, seed)
    else:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, flows.SAMPLE_FLOW).coalesce(1).write.parquet(f"{tmp_path}/d/in/{i}")
        stream = spark.readStream.schema(flows.SAMPLE_FLOW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d/in/*")
        q = flows.chain(stream, steps).writeStream.format("parquet").option("path", f"{tmp_path}/d/out").option("checkpointLocation", f"{tmp_path}/d/c").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        out = spark.read.parquet(f"{tmp_path}/d/out").collect()
    for r in out:
        got.setdefault((r.ch, r.epoch), {})[r.n] = r.v
    for c in range(2):
        for e in range(3):
            v = [0.0] * 3 + [k * (c + 1) + e for k in (x if control == "drain" or e != 1 else x[:4])]
            assert [got[c, e][n] for n in range(len(v))] == [a + b for a, b in zip(v, [0.0, *v])] and len(got[c, e]) == len(v)


def test_what_a_window_holds_is_drained_or_discarded(spark, tmp_path):
    for control, size in (("drain", 10), ("discard", 8)):
        rows = [("s", 0, 0, n, float(n), None, None) for n in range(10)]
        first, then = rows, [("s", 0, 0, None, None, control, 10)] + [("s", 0, 1, n, float(n), None, None) for n in range(4)] + [("s", 0, 1, None, None, "end", 4)]
        for i, part in enumerate((first, then)):
            spark.createDataFrame(part, flows.SAMPLE_FLOW).coalesce(1).write.parquet(f"{tmp_path}/{control}/in/{i}")
        stream = spark.readStream.schema(flows.SAMPLE_FLOW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{control}/in/*")
        out = flows.chain(stream, [stateful.windowing(4, "emit")])
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{control}/out").option("checkpointLocation", f"{tmp_path}/{control}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        got = sorted((r.epoch, r.n) for r in spark.read.parquet(f"{tmp_path}/{control}/out").collect())
        assert got == [(0, n) for n in range(size)] + [(1, n) for n in range(4)]


def counter():
    """A stage that puts its count of packets before each."""
    return stateful.Step(lambda items, memory, position: (position, [bytes([position + i]) + d for i, d in enumerate(items)], memory))


@pytest.mark.parametrize("control", ["drain", "discard"])
def test_counters_start_afresh_after_a_reset(spark, tmp_path, control):
    rows = [("p", 0, 0, b"\x01", None, None), ("p", 0, None, None, control, 1), ("p", 1, 0, b"\x02", None, None), ("p", 1, None, None, "end", 1)]
    got = fed(spark, tmp_path, rows, flows.PACKET_FLOW, 1, lambda s: flows.packets(s, [counter(), counter()]), control)
    assert sorted((r.epoch, r.seq, list(r.data)) for r in got) == [(0, 0, [0, 0, 1]), (1, 0, [0, 0, 2])]


def test_frame_buffer_equals_the_batch_time_stamps(spark, tmp_path):
    rnd = random.Random(4)
    fmt, base = (8000, 2, "f64", True, 3), (1, 8000)
    rows, at = [], 0
    for seq in range(30):
        n = rnd.choice([5, 10, 15])
        pts = rnd.choice([at, at, at, at, at + 1, None])
        rows.append(("s", seq, pts, base, fmt, n, [[float(at + i) for i in range(n)], [-float(at + i) for i in range(n)]], 0, None, None))
        at += n
    control = [("s", None, None, None, None, None, None, 0, "end", 30)]
    got = fed(spark, tmp_path, rows + control, flows.FRAME_FLOW, 4, lambda s: flows.frames(s, [flows.buffering(10, "pad")]), "frames")
    batch = spark.createDataFrame([r[:7] for r in rows], FRAMES)
    want = {r.chunk: r.pts for r in framing.chunk_pts(batch, 10).collect()}
    got = sorted(got, key=lambda r: r.seq)
    assert {r.seq: r.pts for r in got[: at // 10]} == want and len(set(want.values())) > 2
    line = [v for r in got for v in r.samples[0]]
    assert line == [float(i) for i in range(at)] + [0.0] * (-at % 10) and [-v for r in got for v in r.samples[1]] == line
    assert {r.nb_samples for r in got} == {10} and got[0].format.sample_rate == 8000


class FakeMap:
    """A map of the state that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self):
        self.held = {}

    def __getattr__(self, name):
        def call(key, *value):
            self.calls += 1
            return {"containsKey": lambda: key in self.held, "getValue": lambda: self.held[key], "removeKey": lambda: self.held.pop(key), "updateValue": lambda: self.held.__setitem__(key, *value)}[name]()

        return call


class FakeValue(FakeMap):
    def get(self):
        return self.held["v"]

    def update(self, value):
        self.held["v"] = value


class FakeHandle:
    def getValueState(self, name, schema):
        return FakeValue()

    def getMapState(self, name, schema, *more):
        return FakeMap()


def test_waiting_items_are_kept_many_at_a_time():
    n = 6000

    def rows(key, epochs, places, out):
        return pd.DataFrame({"epoch": epochs, "n": places, "v": out[0]})

    flow = flows.Flow([[stateful.passing()]], "n", lambda part: part["v"].to_numpy(float), rows, numbers=True)
    flow.init(FakeHandle())
    items = pd.DataFrame({"epoch": 0, "n": np.arange(n, dtype=float), "v": np.arange(n) * 2.0, "control": None, "count": None})
    shuffled = items.iloc[1:].sample(frac=1, random_state=1)
    end = pd.DataFrame({"epoch": [0], "n": [None], "v": [None], "control": ["end"], "count": [n]})
    assert not list(flow.handleInputRows(("s",), iter([shuffled.iloc[: n // 2]]), None))
    assert not list(flow.handleInputRows(("s",), iter([shuffled.iloc[n // 2 :], end]), None))
    assert len(flow.early.held) == 2
    got = pd.concat(list(flow.handleInputRows(("s",), iter([items.iloc[:1]]), None)))
    assert got["n"].tolist() == list(range(n)) and got["v"].tolist() == [2.0 * i for i in range(n)]
    assert flow.early.calls < 20 and flow.controls.calls < 20 and not flow.early.held


def test_a_table_becomes_as_many_batches_in_order_as_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "ROWS_A_BATCH", 100)
    monkeypatch.setattr(batches, "shared_folder", lambda s: str(tmp_path / "run"))
    rows = [("s", c, n // 35, n % 35, float(n), None, None) for c in range(2) for n in range(200)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, flows.SAMPLE_FLOW)
    out = batches.run_stream(table, lambda s: flows.chain(s, [stateful.windowing(10, "emit")]), "n", then=flows.controls(table, ["stream_id", "ch"], "discard"))
    want = sorted((r[1], r[2], r[3], r[4]) for r in rows if r[3] < 30 or r[2] == 5)
    assert sorted((r.ch, r.epoch, r.n, r.v) for r in out.collect()) == want
    done = [f for f in (tmp_path / "run" / "checkpoint" / "commits").iterdir() if f.name.isdigit()]
    assert len(done) >= 5  # four batches of about a hundred rows, and the last discards


def test_samples_become_as_many_batches_in_order_as_they_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "ROWS_A_BATCH", 100)
    folders = iter(("kept", "run"))
    monkeypatch.setattr(batches, "shared_folder", lambda s: str(tmp_path / next(folders)))
    rows = [("s", c, n, float(n + c)) for c in range(2) for n in range(195)]
    random.Random(4).shuffle(rows)
    out = batches.through_stream(spark.createDataFrame(rows, "stream_id string, ch int, n bigint, v double"), lambda s: stateful.rechunk(s, 50, "pad"))
    want = sorted([r[1:] for r in rows] + [(c, n, 0.0) for c in range(2) for n in range(195, 200)])
    assert sorted((r.ch, r.n, r.v) for r in out.collect()) == want
    done = [f for f in (tmp_path / "run" / "checkpoint" / "commits").iterdir() if f.name.isdigit()]
    assert len(done) >= 5  # four batches of about a hundred rows, and the ends
    for k in range(4):
        assert spark.read.parquet(f"{tmp_path}/run/staged/batch_={k}").count() < 200
