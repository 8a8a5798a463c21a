"""Rollers: in memory, in batch and as streams give the same."""

import math
import sys

import pytest
from pyspark import cloudpickle

from tidemill.streaming import rollers as r

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests' folder


def test_ring():
    ring = r.Ring(2)
    assert [ring.push(v) for v in (1.0, 2.0, 3.0)] == [(0.0, False), (0.0, False), (1.0, True)]
    assert (ring.at(0), ring.at(1), ring.len(), ring.cap(), ring.full()) == (2.0, 3.0, 2, 2, True)
    with pytest.raises(IndexError):
        ring.at(2)
    with pytest.raises(ValueError):
        r.Ring(-1)
    ring.reset()
    assert ring.len() == 0 and r.Ring(0).push(1.0) == (0.0, False)


def test_sum_evicts_without_trace():
    assert r.apply([1e16, *[1.0] * 7], r.Sum(2))[2] == 2
    out = r.apply([1.0, math.nan, 2.0, 3.0], r.Sum(2))
    assert out[3] == 5 and all(v != v for v in out[:3])


@pytest.mark.parametrize("kind", sorted(r.KINDS))
def test_state_round_trip(kind):
    values = [math.sin(i) * 10 for i in range(40)]
    whole = r.apply(values, r.KINDS[kind](5))
    first = r.KINDS[kind](5)
    head = r.apply(values[:13], first)
    second = r.KINDS[kind](5)
    second.restore(first.state())
    tail = r.apply(values[13:], second)
    assert [v for v in head + tail if v == v] == [v for v in whole if v == v]


@pytest.mark.parametrize("kind", sorted(r.KINDS))
def test_batch_equals_memory(spark, kind):
    rows = [(k, i, math.cos(i * (k + 1)) * 7) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    got = {(x.k, x.i): x[kind] for x in r.apply_batch(df, ["k"], "i", "x", kind, 4).collect()}
    for k in range(3):
        want = r.apply([v for key, _, v in rows if key == k], r.KINDS[kind](4))
        assert all(a == b or (a != a and b != b) for a, b in zip([got[k, i] for i in range(30)], want, strict=True))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float((i * 7 + k) % 13)) for k in range(2) for i in range(40)]
    schema = "k int, i int, x double"
    for part in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 10 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = r.apply_stream(stream, ["k"], "i", "x", "ema", 3).writeStream.format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(x.k, x.i): x.ema for x in spark.sql("select * from rolled").collect()}
    assert len(got) == len(rows)
    for k in range(2):
        want = r.apply([v for key, _, v in rows if key == k], r.EMA(3))
        assert all((a is None and b != b) or a == pytest.approx(b, rel=1e-12) for a, b in zip([got[k, i] for i in range(40)], want, strict=True))


@pytest.mark.parametrize("kind", ["sum", "sma", "rma"])
@pytest.mark.parametrize("in_order", [False, True])
def test_other_streams_equal_memory(spark, tmp_path, kind, in_order):
    rows = [(k, i, float((i * 7 + k) % 13)) for k in range(2) for i in range(40)]
    for part in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 10 == part], "k int, i int, x double").coalesce(1).sortWithinPartitions("k", "i").write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("k int, i int, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    name = f"rolled_{kind}_{in_order}"
    query = r.apply_stream(stream, ["k"], "i", "x", kind, 3, in_order).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(x.k, x.i): x[kind] for x in spark.sql(f"select * from {name}").collect()}
    for k in range(2):
        want = r.apply([v for key, _, v in rows if key == k], r.KINDS[kind](3))
        assert all((a is None and b != b) or a == pytest.approx(b, rel=1e-12) for a, b in zip([got[k, i] for i in range(40)], want, strict=True))


class Spread(r.Roller):
    """A roller of a user: the greatest of the last n values less the least."""

    forgets = True

    def reset(self):
        self.last = []

    def push(self, v):
        self.last = [*self.last, v][-self.n :]
        return max(self.last) - min(self.last) if len(self.last) == self.n else math.nan

    def state(self):
        return list(self.last)

    def restore(self, state):
        self.last = list(state)


class Counted(Spread):
    """Never forgets."""

    forgets = False

    def push(self, v):
        self.last = [self.last[0] + 1 if self.last else 1.0]
        return self.last[0]


def _spread(n=4):
    return Spread(n)


def _alike(got, want):
    return len(got) == len(want) and all(a == b or ((a is None or a != a) and b != b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("keys", [["k"], []])
def test_rollers_of_users_in_batches(spark, keys):
    rows = [(k, k * 1000 + i, math.cos(i * (k + 1)) * 7) for k in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    got = r.apply_batch(df, keys, "i", "x", _spread, pieces=5)
    assert got.columns == ["k", "i", "x", "spread"]
    got = {x.i: x.spread for x in got.collect()}
    counts = {x.i: x.c for x in r.apply_batch(df, keys, "i", "x", lambda: Counted(1), out="c", pieces=5).collect()}
    for group in [[x for x in rows if x[0] == k] for k in range(2)] if keys else [rows]:
        assert _alike([got[i] for _, i, _ in group], r.apply([v for _, _, v in group], Spread(4)))
        assert [counts[i] for _, i, _ in group] == list(range(1, len(group) + 1))
    with pytest.raises(TypeError):
        r.apply_batch(df, keys, "i", "x", lambda: 3)
    with pytest.raises(ValueError):
        r.apply_batch(df, keys, "i", "x", "sum", 0)


def test_streams_wait_for_their_turn_and_go_on_after_a_stop(spark, tmp_path):
    """Rows come out of order, also across micro-batches, and the query is stopped between them."""
    rows = [(k, i, float((i * 7 + k) % 13)) for k in range(2) for i in range(40)]
    order = sorted(rows, key=lambda x: ((x[1] * 17) % 9 + x[1], x[0]))  # each at most 8 seconds late
    schema = "k int, ts timestamp, x double"

    def arrive(part, some):
        df = spark.createDataFrame(some, "k int, i int, x double").selectExpr("k", "timestamp_seconds(1000000 + i) ts", "x")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{part}")

    def run(make):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = r.apply_stream(stream, ["k"], "ts", "x", make, delay="10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(f"{tmp_path}/out").selectExpr("k", "cast(ts as long) - 1000000 i", "spread").collect()

    arrive(0, order[:30])
    arrive(1, order[30:50])
    early = run(_spread)
    assert 0 < len(early) < 50  # what the watermark hasn't passed still waits
    arrive(2, order[50:])
    arrive(3, [(0, 500, 0.0)])
    arrive(4, [(0, 7, 99.0)])  # much too late
    found = run(_spread)
    got = {(x.k, x.i): x.spread for x in found}
    assert len(got) == len(found) == len(rows)
    for k in range(2):
        assert _alike([got[k, i] for i in range(40)], r.apply([v for key, _, v in rows if key == k], Spread(4)))
    with pytest.raises(ValueError):
        r.apply_stream(spark.createDataFrame([], "k int, i int, x double"), ["k"], "i", "x", _spread, delay="1 second")


def test_sum_of_long_windows_takes_few_steps():
    values = [math.sin(i) * 10 ** (i % 7) for i in range(3000)]
    out = r.apply(values, r.Sum(1000))
    assert all(out[i] == pytest.approx(math.fsum(values[i - 999 : i + 1]), rel=1e-12, abs=1e-9) for i in range(999, 3000))
    out = r.apply([1.0, math.inf, 2.0, 3.0, 4.0, math.nan, 1.0, 2.0], r.Sum(2))
    assert out[1] == out[2] == math.inf and out[3:5] == [5, 7] and out[5] != out[5] and out[7] == 3
