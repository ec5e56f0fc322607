import os

import pytest

from tidewell.model import InvalidData
from tidewell.streaming import messages


def framed(*bodies):
    return b"".join(len(b).to_bytes(4, "big") + b for b in bodies)


def put(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def test_a_restarted_stream_reads_each_message_once(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    spark.dataSource.register(messages.MessageSource)

    def run():
        stream = spark.readStream.format("tidewell-messages").option("split", "20").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((os.path.basename(r.stream_id), r.seq, bytes(r.data)) for r in spark.read.schema(messages.MESSAGES).parquet(f"{tmp_path}/out").collect())

    put(folder / "a.cap", framed(b"one", b"two", b"x" * 50))
    put(folder / "b.cap", framed(b"first") + (9).to_bytes(4, "big") + b"half")  # a message that is still being written
    first = [("a.cap", 0, b"one"), ("a.cap", 1, b"two"), ("a.cap", 2, b"x" * 50), ("b.cap", 0, b"first")]
    assert run() == first
    assert run() == first
    put(folder / "b.cap", b"-done" + framed(b"third") + bytes(4) + framed(b"after the end"))
    put(folder / "a.cap", framed(b"four"))
    put(folder / "c.cap", framed(b"new") + b"\0\0")
    then = [("a.cap", 3, b"four"), ("b.cap", 1, b"half-done"), ("b.cap", 2, b"third"), ("c.cap", 0, b"new")]
    assert run() == sorted(first + then)
    batch = spark.read.format("tidewell-messages").option("split", "1").load(f"{folder}/[ab].cap")
    assert batch.count() == 7 and batch.rdd.getNumPartitions() == 7


def test_a_batch_has_a_bounded_number_of_parts(tmp_path, monkeypatch):
    put(tmp_path / "a.cap", framed(*[b"%04d" % i for i in range(1000)]))
    put(tmp_path / "b.cap", framed(*[b"x"] * 10))
    monkeypatch.setattr(messages, "MOST_PARTS", 16)
    stream = messages.MessageStream({"path": str(tmp_path), "split": "8"})
    end = stream.latestOffset()
    for reader in (stream, messages.MessageStream({"path": str(tmp_path), "split": "8"})):  # one that has met the borders, one that has not
        parts = reader.partitions({}, end)
        assert len(parts) <= 18
        rows = [(os.path.basename(path), seq, bytes(data)) for p in parts for path, seq, data in reader.read(p)]
        assert rows == [("a.cap", i, b"%04d" % i) for i in range(1000)] + [("b.cap", i, b"x") for i in range(10)]


def test_every_sink_takes_a_batch_once_though_one_fails(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    calls, fails = [], [True]

    def counted(name):
        keep = messages.table(f"{tmp_path}/{name}")

        def sink(df, batch):
            calls.append((name, batch))
            if name == "second" and batch == 1 and fails:
                fails.pop()
                df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={batch}")  # it fails after it has written
                raise ValueError("sink lost")
            keep(df, batch)

        return sink

    def run():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return messages.to_sinks_once(stream, {n: counted(n) for n in ("first", "second", "third")}, f"{tmp_path}/c", trigger={"availableNow": True})

    with pytest.raises(Exception, match="sink lost"):
        run().awaitTermination()
    assert calls == [("first", 0), ("second", 0), ("third", 0), ("first", 1), ("second", 1)]
    run().awaitTermination()
    assert calls[5:] == [("second", 1), ("third", 1), ("first", 2), ("second", 2), ("third", 2)]
    for name in ("first", "second", "third"):
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == list(range(30))
    with pytest.raises(InvalidData):
        messages.to_sinks_once(None, {}, str(tmp_path))
