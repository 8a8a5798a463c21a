"""Stateful rollers: bounded series by `apply`, streams by transformWithState.

A roller takes one value and gives one; its state is a list of doubles, so that the same step runs in memory, in batch kernels
and in Spark's state store. Those at hand have names (`KINDS`); any other is a subclass of `Roller`, given as something that makes one.

A stream has no order of rows across micro-batches. By default rows are taken in order of the order column within each
micro-batch, so sources must deliver a key's rows in order. With a `delay` rows wait in the state store until the watermark has
passed them, and are taken in order then; those that come later than that are left out, as by all of Spark's operators with a
watermark. Either way a stream that is stopped goes on from its checkpoint."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType, TimestampType

from tidemill.operators.series import Kernel, Series

NAN = float("nan")


class Ring:
    """The last `capacity` values, oldest first."""

    def __init__(self, capacity: int):
        if capacity < 0:
            raise ValueError("negative capacity")
        self.capacity = capacity
        self.values: list[float] = [0.0] * capacity
        self.first = self.count = 0

    def cap(self) -> int:
        return self.capacity

    def len(self) -> int:
        return self.count

    def full(self) -> bool:
        return 0 < self.capacity == self.count

    def at(self, i: int) -> float:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return self.values[(self.first + i) % self.capacity]

    def push(self, v: float) -> tuple[float, bool]:
        """What falls out, and whether anything did. Without capacity nothing is kept."""
        if not self.capacity:
            return 0.0, False
        if self.count < self.capacity:
            self.values[(self.first + self.count) % self.capacity] = v
            self.count += 1
            return 0.0, False
        out, self.values[self.first] = self.values[self.first], v
        self.first = (self.first + 1) % self.capacity
        return out, True

    def reset(self) -> None:
        self.first = self.count = 0


def _added(total: tuple[float, float], v: float) -> tuple[float, float]:
    """A sum and what rounding has lost of it, with v added."""
    new = total[0] + v
    lost = (total[0] - new) + v if abs(total[0]) >= abs(v) else (v - new) + total[0]
    return new, total[1] + lost if math.isfinite(new) else 0.0


class Roller:
    """What a subclass gives: reset() to the beginning, push(v) for the next value, and its state as numbers, to stop with and to
    go on from. Two rollers of equal states must give equal results from there on."""

    #: Whether the state after many values hardly depends on how it began. If so, batches may cut long series into blocks.
    forgets = False

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("window must be at least 1")
        self.n = window
        self.reset()

    def warmup(self) -> int:
        return self.n

    def window(self) -> int:
        return self.n

    def reset(self) -> None:
        raise NotImplementedError

    def push(self, v: float) -> float:
        raise NotImplementedError

    def state(self) -> list[float]:
        raise NotImplementedError

    def restore(self, state: list[float]) -> None:
        raise NotImplementedError


class Sum(Roller):
    """Sum of the last n values; NaN until there are n and while one of them is NaN. The window is two stacks: new values
    go on one, whose compensated sum grows; old ones leave the other, which has the sum of what is left with each value and
    is filled from the first when empty. So a value costs a few additions, and none is ever taken out of a sum."""

    forgets = True

    def reset(self) -> None:
        self.new: list[float] = []
        self.sum: tuple[float, float] = (0.0, 0.0)
        #: Value, and the sum from it to the newest here; the oldest is last.
        self.old: list[tuple[float, tuple[float, float]]] = []

    def push(self, v: float) -> float:
        if len(self.new) + len(self.old) == self.n:
            if not self.old:
                total = (0.0, 0.0)
                while self.new:
                    x = self.new.pop()
                    total = _added(total, x)
                    self.old.append((x, total))
                self.sum = (0.0, 0.0)
            self.old.pop()
        self.new.append(v)
        self.sum = _added(self.sum, v)
        if len(self.new) + len(self.old) < self.n:
            return NAN
        total = self.sum
        if self.old:
            rest = self.old[-1][1]
            total = _added(_added(total, rest[0]), rest[1]) if math.isfinite(rest[0]) else _added(total, rest[0])
        return total[0] + total[1] if math.isfinite(total[0]) else total[0]

    def state(self) -> list[float]:
        return [v for v, _ in reversed(self.old)] + self.new

    def restore(self, state: list[float]) -> None:
        self.reset()
        for v in state:
            self.push(v)


class SMA(Sum):
    def push(self, v: float) -> float:
        return super().push(v) / self.n


class _Recursive(Roller):
    forgets = True

    def alpha(self) -> float:
        raise NotImplementedError

    def reset(self) -> None:
        self.count, self.total, self.lost, self.value = 0, 0.0, 0.0, NAN

    def push(self, v: float) -> float:
        if self.count < self.n:
            self.count += 1
            new = self.total + v
            self.lost += (self.total - new) + v if abs(self.total) >= abs(v) else (v - new) + self.total
            self.total = new
            if self.count == self.n:
                self.value = (self.total + self.lost) / self.n
        else:
            a = self.alpha()
            self.value = a * v + (1 - a) * self.value
        return self.value

    def state(self) -> list[float]:
        return [float(self.count), self.total, self.lost, self.value]

    def restore(self, state: list[float]) -> None:
        self.count, self.total, self.lost, self.value = int(state[0]), *state[1:]


class EMA(_Recursive):
    """Seeded with the mean of the first n values; a NaN stays."""

    def alpha(self) -> float:
        return 2 / (self.n + 1)


class RMA(_Recursive):
    def alpha(self) -> float:
        return 1 / self.n


KINDS: dict[str, type[Roller]] = {"sum": Sum, "sma": SMA, "ema": EMA, "rma": RMA}


def apply(values: Iterable[float], roller: Roller) -> list[float]:
    return [roller.push(v) for v in values]


Maker = Callable[[], Roller]


def _maker(kind: str | Maker, n: int | None, out: str | None) -> tuple[Maker, str]:
    """What makes the roller, and the name of its column."""
    if isinstance(kind, str):
        made = KINDS[kind]
        make, out = (lambda: made(n)), out or kind
    else:
        make = kind
    if not isinstance(roller := make(), Roller):
        raise TypeError(f"{roller!r} is no Roller")
    return make, out or type(roller).__name__.lower()


class _Pushed:
    """A roller as a kernel."""

    def __init__(self, roller: Roller):
        self.roller = roller

    def run(self, x: np.ndarray) -> tuple[np.ndarray]:
        return (np.array([self.roller.push(v) for v in x.tolist()], np.float64),)

    def state(self) -> list[float]:
        return self.roller.state()

    def restore(self, state: list[float]) -> None:
        self.roller.restore(state)


def apply_batch(df: DataFrame, keys: list[str], ord: str, x: str, kind: str | Maker, n: int | None = None, out: str | None = None, pieces: int | None = None) -> DataFrame:
    """df with column `out` (the kind's name): the roller over each key's rows in order. `pieces` is that of `Series`; only
    rollers that forget are run in blocks."""
    make, out = _maker(kind, n, out)

    def op(s: Series):
        return (yield Kernel(lambda: _Pushed(make()), [x], machine=make().forgets))

    return Series(df, keys, ord, pieces).compute(**{out: op})


class RollerProcessor(StatefulProcessor):
    """A roller for each key; its state is one array of doubles. It emits every row with the roller's value."""

    def __init__(self, make: Maker, out: str, ord: str, x: str, columns: list[str], in_order: bool = False):
        self.make, self.out, self.ord, self.x, self.columns, self.in_order = make, out, ord, x, columns, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("values", ArrayType(DoubleType(), False), True)])
        self.kept = handle.getValueState("roller", schema)

    def rolled(self, each: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = self.make()
        if self.kept.exists():
            # A NaN is stored as the NULL that pandas makes of it.
            roller.restore([NAN if v is None else float(v) for v in self.kept.get()[0]])
        for got in each:
            made = [roller.push(NAN if v is None else float(v)) for v in got[self.x]]
            yield got[self.columns].assign(**{self.out: np.array(made, np.float64)})
        self.kept.update((roller.state(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self.rolled(rows if self.in_order else [pd.concat(list(rows)).sort_values(self.ord, kind="stable")])

    def close(self) -> None:
        pass


class WaitingRollerProcessor(RollerProcessor):
    """Rows wait, as Arrow batches in a list, until the watermark has passed them. A timer stands at the first one that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("rows", BinaryType(), True)]))

    def _keep(self, rows: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def _wake(self, rows: pd.DataFrame) -> None:
        micros = _micros(rows[self.ord]).min()
        self.handle.registerTimer(int(-(-micros // 1000)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for got in rows:
            got = got[got[self.ord].notna()]
            if len(got):
                self.waiting.appendValue((self._keep(got[self.columns]),))
                self._wake(got)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(bytes(v[0])).read_pandas() for v in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values(self.ord, kind="stable")
        passed = _micros(rows[self.ord]) <= timerValues.getCurrentWatermarkInMs() * 1000
        if not passed.any():
            self._wake(rows)
            return
        rest = rows[~passed]
        if len(rest):
            self.waiting.put([(self._keep(rest),)])
            self._wake(rest)
        else:
            self.waiting.clear()
        yield from self.rolled([rows[passed]])


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def apply_stream(
    df: DataFrame, keys: list[str], ord: str, x: str, kind: str | Maker, n: int | None = None, in_order: bool = False, out: str | None = None, delay: str | None = None
) -> DataFrame:
    """A streaming df with column `out` (the kind's name); needs the RocksDB state store. NaN shows as NULL in the result. A
    key's rows of a micro-batch are sorted in memory; with `in_order`, which says that they come so, they are taken as they stream
    in. With `delay`, a watermark on the order column, which must be a timestamp, rows wait for their turn: each key's rows come out in
    order, whatever order they came in, once the watermark has passed them; rows without a timestamp are left out."""
    make, out = _maker(kind, n, out)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    processor = RollerProcessor
    if delay is not None:
        if not isinstance(df.schema[ord].dataType, TimestampType):
            raise ValueError(f"{ord} must be a timestamp to wait by")
        df, processor = df.withWatermark(ord, delay), WaitingRollerProcessor
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor(make, out, ord, x, df.columns, in_order), outputStructType=schema, outputMode="append", timeMode="none" if delay is None else "eventTime"
    )
