"""Flows: chains of stateful steps and forks of such chains over streams, with epochs that a reset ends.

A row is an item (a sample, a packet, a frame) of an epoch of a stream, at a position from 0 in it, in any order; or a control row,
which has no position and says how an epoch ends:

* ``end``: the stream is over when ``count`` items have come; what the steps still hold is given out, and the state goes;
* ``drain``: the same for the epoch; the steps then start afresh with the next epoch;
* ``discard``: at once; what the steps hold, what waits and what still comes of that epoch is dropped.

State is kept by key in Spark's state store: the epoch, the next position and the steps' memories as one value, and a map of the items
that wait for those before them, by stretches of ``STRETCH`` positions of an epoch, so that they are written and read many at a time. Branches of a fork hold what they have given until all have; what one has more
than another when the epoch ends is dropped. All branches of a key are one state, so a fork is one shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewell.model import FRAMES, InvalidData
from tidewell.operators.forkjoin import Reducer, in_domain
from tidewell.streaming.stateful import Step

CONTROLS = ("end", "drain", "discard")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples that come before their step and its control: stream_id, ch, epoch, n, v, control, count.
SAMPLE_FLOW = "stream_id string, ch int, epoch bigint, n bigint, v double, control string, count bigint"
PACKET_FLOW = "stream_id string, epoch bigint, seq bigint, data binary, control string, count bigint"
ROWS = 4096
#: Positions of an epoch whose waiting items are one entry of the state.
STRETCH = 4096
#: Runs of items that are handed on at once.
SOME = 64


@dataclass
class Branch:
    """What a chain of steps remembers, and what it has given that other branches have not."""

    memories: list = field(default_factory=list)
    #: Items that each step has taken.
    taken: list = field(default_factory=list)
    given: Any = field(default_factory=list)


@dataclass
class Held:
    epoch: int
    next: int
    #: Positions that have been given out of the epoch.
    released: int
    branches: list[Branch]


class Flow(StatefulProcessor):
    """The steps of all branches along one key's items."""

    def __init__(self, branches: list[list[Step]], position: str, values: Callable[[pd.DataFrame], list], rows: Callable[[tuple, np.ndarray, np.ndarray, list], pd.DataFrame], numbers: bool):
        self.steps, self.position, self.values, self.rows, self.numbers = branches, position, values, rows, numbers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "data binary")
        self.early = handle.getMapState("early", "epoch bigint, stretch bigint", "data binary")
        self.controls = handle.getMapState("controls", "epoch bigint", "control string, count bigint")

    def close(self) -> None:
        pass

    def fresh(self, epoch: int) -> Held:
        return Held(epoch, 0, 0, [Branch([[] for _ in s], [0] * len(s)) for s in self.steps])

    def through(self, steps: list[Step], branch: Branch, items: Any, end: bool) -> None:
        """Hand ``items`` from step to step; at the end each step gives what it holds to those after it."""
        for k, step in enumerate(steps):
            given = []
            if len(items):
                _, out, branch.memories[k] = step.kernel(items, branch.memories[k], branch.taken[k])
                branch.taken[k] += len(items)
                given.append(out)
            if end:
                given.append(step.ending(branch.memories[k], branch.taken[k])[1])
            items = self.joined(given)
        branch.given = self.joined([branch.given, items])

    def joined(self, parts: list) -> Any:
        if self.numbers:
            return np.concatenate([np.asarray(p, float) for p in parts]) if parts else np.zeros(0)
        return [x for p in parts for x in p]

    def feed(self, held: Held, items: Any, end: bool = False) -> list[list]:
        """What all branches have given by now, position by position."""
        for steps, branch in zip(self.steps, held.branches):
            self.through(steps, branch, items, end)
        n = min(len(b.given) for b in held.branches)
        out = [b.given[:n] for b in held.branches]
        for b in held.branches:
            b.given = b.given[n:]
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.held.get()[0]) if self.held.exists() else self.fresh(0)
        fresh, told = self.sorted_in(held, pd.concat(list(rows), ignore_index=True))
        waiting = {tuple(k) for k in self.early.keys()} if self.early.exists() else set()
        stored = {k[0]: tuple(v) for k, v in self.controls.iterator()} if self.controls.exists() else {}
        controls = stored | told
        made, ended = [], False
        while not ended:
            # this epoch's items, a stretch at a time: the new ones and those that waited, as far as they follow one another
            places, values = fresh.pop(held.epoch, (np.zeros(0, np.int64), []))
            at = int(np.searchsorted(places, held.next))
            while True:
                stretch = held.next // STRETCH
                stop = int(np.searchsorted(places, (stretch + 1) * STRETCH))
                p, v = self.met(waiting, (held.epoch, stretch), places[at:stop], values[at:stop])
                at, first = stop, int(np.searchsorted(p, held.next))
                p, v = p[first:], v[first:]
                run = int((p == held.next + np.arange(len(p))).cumprod().sum())
                if run:
                    made += self.given(held, self.feed(held, v[:run]))
                    held.next += run
                self.wait(waiting, held.epoch, p[run:], v[run:])
                if held.next < (stretch + 1) * STRETCH:
                    break
                if len(made) >= SOME:
                    yield from self.emit(key, made)
                    made = []
            control, count = controls.get(held.epoch, (None, None))
            if control == "discard" or control is not None and count == held.next:
                if control != "discard":
                    made += self.given(held, self.feed(held, [], end=True))
                controls.pop(held.epoch)
                if held.epoch in stored:
                    self.controls.removeKey((held.epoch,))
                for place in [w for w in waiting if w[0] == held.epoch]:
                    self.early.removeKey(place)
                    waiting.discard(place)
                ended = control == "end"
                held = self.fresh(held.epoch + 1)
                if len(made) >= SOME:
                    yield from self.emit(key, made)
                    made = []
                continue
            self.wait(waiting, held.epoch, places[at:], values[at:])
            break
        yield from self.emit(key, made)
        if ended:
            self.held.clear()
            self.early.clear()
            self.controls.clear()
        else:
            for epoch, (places, values) in fresh.items():
                self.wait(waiting, epoch, places, values)
            for epoch, told_ in controls.items():
                if stored.get(epoch) != told_:
                    self.controls.updateValue((epoch,), told_)
            self.held.update((pickle.dumps(held),))

    def sorted_in(self, held: Held, got: pd.DataFrame) -> tuple[dict, dict]:
        """New items by epoch, as (positions, values) in order, and new controls; what is over is left out."""
        is_told = got["control"].notna().to_numpy()
        told = got[is_told]
        controls = {
            int(epoch): (control, None if pd.isna(count) else int(count))
            for epoch, control, count in zip(told["epoch"].tolist(), told["control"], told["count"])
            if epoch >= held.epoch
        }
        items = got[~is_told & (got["epoch"] >= held.epoch).to_numpy()]
        epochs, places = (items[c].to_numpy().astype(np.int64) for c in ("epoch", self.position))
        order = np.lexsort((places, epochs))
        epochs, places = epochs[order], places[order]
        once = np.ones(len(order), bool)
        once[1:] = (epochs[1:] != epochs[:-1]) | (places[1:] != places[:-1])
        epochs, places = epochs[once], places[once]
        values = self.values(items.iloc[order[once]])
        firsts = np.flatnonzero(np.append(True, epochs[1:] != epochs[:-1])) if len(epochs) else np.zeros(0, np.int64)
        ends = [*firsts[1:].tolist(), len(epochs)]
        return {int(epochs[a]): (places[a:b], values[a:b]) for a, b in zip(firsts.tolist(), ends)}, controls

    def met(self, waiting: set, place: tuple[int, int], places: np.ndarray, values: Any) -> tuple[np.ndarray, Any]:
        """Items of a stretch with those that waited, which are taken out of the state."""
        if place not in waiting:
            return places, values
        early, early_values = pickle.loads(self.early.getValue(place)[0])
        self.early.removeKey(place)
        waiting.discard(place)
        if not len(places):
            return early, early_values
        both, values = np.concatenate([early, places]), self.joined([early_values, values])
        both, order = np.unique(both, return_index=True)
        return both, values[order] if self.numbers else [values[i] for i in order.tolist()]

    def wait(self, waiting: set, epoch: int, places: np.ndarray, values: Any) -> None:
        """Keep items for later, a stretch an entry."""
        at = 0
        while at < len(places):
            stretch = int(places[at]) // STRETCH
            stop = int(np.searchsorted(places, (stretch + 1) * STRETCH))
            entry = self.met(waiting, (epoch, stretch), places[at:stop], values[at:stop])
            self.early.updateValue((epoch, stretch), (pickle.dumps(entry),))
            waiting.add((epoch, stretch))
            at = stop

    def given(self, held: Held, out: list) -> list[tuple]:
        """What an epoch gives, as (epoch, positions, the branches' values)."""
        n = len(out[0])
        held.released += n
        return [(held.epoch, np.arange(held.released - n, held.released, dtype=np.int64), out)] if n else []

    def emit(self, key, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if not made:
            return
        epochs = np.concatenate([np.full(len(p), e, np.int64) for e, p, _ in made])
        places = np.concatenate([p for _, p, _ in made])
        out = [self.joined([o[k] for _, _, o in made]) for k in range(len(self.steps))]
        for at in range(0, len(places), ROWS):
            yield self.rows(key, epochs[at : at + ROWS], places[at : at + ROWS], [b[at : at + ROWS] for b in out])


def use_state_store(spark: SparkSession) -> None:
    """Flows keep maps in their state, which needs the store that has column families."""
    if spark.conf.get(STATE_STORE) != ROCKS:
        spark.conf.set(STATE_STORE, ROCKS)


def _run(stream: DataFrame, keys: list[str], flow: Flow, schema: str) -> DataFrame:
    use_state_store(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(flow, StructType.fromDDL(schema), "Append", "None")


def fork_join(samples: DataFrame, branches: list[list[Step]], reducer: Reducer, sample_type: str = "f64") -> DataFrame:
    """stream_id, ch, epoch, n, v: the branches' outputs at each position, reduced in the normalised domain of their type.

    ``samples`` are ``SAMPLE_FLOW`` rows. A position is given out when all branches have it.
    """
    if not branches:
        raise InvalidData("a fork needs one branch at least")

    def rows(key, epochs, places, out):
        return pd.DataFrame({"stream_id": key[0], "ch": np.int32(key[1]), "epoch": epochs, "n": places, "vs": np.column_stack(out).tolist()})

    flow = Flow(branches, "n", lambda part: part["v"].to_numpy(float), rows, numbers=True)
    met = _run(samples, ["stream_id", "ch"], flow, "stream_id string, ch int, epoch bigint, n bigint, vs array<double>")
    reduced = in_domain(reducer, sample_type)([F.col("vs")[i] for i in range(len(branches))])
    return met.select("stream_id", "ch", "epoch", "n", reduced.alias("v"))


def chain(samples: DataFrame, steps: list[Step]) -> DataFrame:
    """stream_id, ch, epoch, n, v: ``SAMPLE_FLOW`` rows through steps one after another."""
    return fork_join(samples, [steps], lambda vs: vs[0])


def packets(stream: DataFrame, steps: list[Step]) -> DataFrame:
    """stream_id, epoch, seq, data: ``PACKET_FLOW`` rows through steps whose kernels take and give lists of bytes."""

    def rows(key, epochs, places, out):
        return pd.DataFrame({"stream_id": key[0], "epoch": epochs, "seq": places, "data": out[0]})

    flow = Flow([steps], "seq", lambda part: part["data"].tolist(), rows, numbers=False)
    return _run(stream, ["stream_id"], flow, "stream_id string, epoch bigint, seq bigint, data binary")


def _plain(x):
    """Values as Python's own, so that they can be kept and handed back."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if isinstance(x, np.ndarray | list | tuple):
        return [_plain(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


def buffering(size: int, tail: str = "keep") -> Step:
    """A buffer of frames: windows of ``size`` samples of all channels, with time stamps while those of the frames continue.

    Time stamps are trusted from a frame on that comes into the empty buffer, until one does not continue or the time base changes; then
    windows have none until the buffer has run empty. ``tail``: at the end a short rest is kept back (dropped), emitted, or padded with zeros.
    """
    if size < 1 or tail not in ("keep", "emit", "pad"):
        raise InvalidData("a window holds one sample at least, and its tail is kept, emitted or padded")

    def window(planes: list, base: int | None, like: dict) -> dict:
        return like | {"pts": base, "nb_samples": len(planes[0]), "samples": planes}

    def kernel(frames, memory, position):
        planes, base, like = memory or ([], None, None)
        out = []
        for f in frames:
            if not f["nb_samples"]:
                continue
            if like is not None and f["format"] != like["format"]:
                raise InvalidData("frames differ from the stream's format")
            held = len(planes[0]) if planes else 0
            if like is not None and f["time_base"] != like["time_base"]:
                base = None
            if f["pts"] is not None and base is None and not held:
                base = f["pts"]
            elif f["pts"] is None or base is None or f["pts"] != base + held:
                base = None
            like = {"time_base": like["time_base"] if like else f["time_base"], "format": f["format"]}
            planes = [[*p, *s] for p, s in zip(planes, f["samples"])] if planes else [list(s) for s in f["samples"]]
            at = 0
            while len(planes[0]) - at >= size:
                out.append(window([p[at : at + size] for p in planes], base, like))
                base = None if base is None else base + size
                at += size
            planes = [p[at:] for p in planes]
        return position, out, [planes, base, like]

    def ending(memory, position):
        planes, base, like = memory or ([], None, None)
        if tail == "keep" or not planes or not planes[0]:
            return position, []
        rest = [[*p, *[0.0] * (size - len(p))] for p in planes] if tail == "pad" else planes
        return position, [window(rest, base, like)]

    return Step(kernel, ending)


#: Frames and control rows of a flow.
FRAME_FLOW = f"{FRAMES}, epoch bigint, control string, count bigint"


def frames(stream: DataFrame, steps: list[Step]) -> DataFrame:
    """Frames (with ``epoch``) of ``FRAME_FLOW`` rows through steps whose kernels take and give lists of frames."""
    fields = ["pts", "time_base", "format", "nb_samples", "samples"]

    def values(part: pd.DataFrame) -> list:
        return [{k: None if k == "pts" and pd.isna(v) else _plain(v) for k, v in zip(fields, row)} for row in zip(*(part[c].tolist() for c in fields))]

    def rows(key, epochs, places, out):
        made = [{"stream_id": key[0], "seq": seq} | f | {"epoch": epoch} for epoch, seq, f in zip(epochs.tolist(), places.tolist(), out[0])]
        pdf = pd.DataFrame(made)
        pdf["pts"] = pdf["pts"].astype("Int64")
        return pdf[["stream_id", "seq", *fields, "epoch"]]

    return _run(stream, ["stream_id"], Flow([steps], "seq", values, rows, numbers=False), f"{FRAMES}, epoch bigint")


def controls(rows: DataFrame, keys: list[str], kind: str, last: str = "end") -> DataFrame:
    """A control row for every epoch of ``rows`` (a flow's items): ``kind``, or ``last`` for a stream's last epoch."""
    if kind not in CONTROLS or last not in CONTROLS:
        raise InvalidData(f"epochs are ended by {', '.join(CONTROLS)}")
    counted = rows.groupBy(*keys, "epoch").agg(F.count(F.lit(1)).alias("count"))
    final = F.col("epoch") == F.max("epoch").over(Window.partitionBy(*keys))
    told = counted.withColumn("control", F.when(final, F.lit(last)).otherwise(F.lit(kind)))
    made = {"epoch", "control", "count", *keys}
    return told.select(*[F.col(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
