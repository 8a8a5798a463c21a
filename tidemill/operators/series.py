"""Ordered series in a DataFrame: keys, an order column, and operators on columns.

An operator is a function of a `Series` and columns that returns a column or a dict of columns, or a generator that first
yields what it needs computed: a column (a window expression that others build on) or a `Kernel` (a recurrence). `compute`
advances all operators together, so that those of one depth share one Window stage and all kernels of a depth share one
pass over the rows. Windows cost one shuffle by key; Catalyst groups expressions of one specification into one node.

Kernels read each key's rows in order from sorted partitions and keep a fixed state, so a key's rows are never held in
memory together, however many there are; the rows of one key go through one task.

A series with `pieces`, or without keys, is cut into blocks of rows that many tasks work on; see `pieces`. Operators then ask for
ordered aggregates (`Running`, `Since`) and places in a sort (`Place`), which are windows by key otherwise.

The order column must be unique within a key. NULL input counts as NaN. Without keys all rows are one series."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemill.functions.ieee import NAN, col, no_nan, nz, or_nan
from tidemill.operators import kernels
from tidemill.operators.kernels import Rows

#: The period beyond which order statistics ask for ranks instead of sorting each window.
LONG_ORDER = 64


@dataclass
class Kernel:
    """A recurrence or moving window: `make()` gives either an object of `kernels`, whose run() takes arrays, or a function
    that takes one row's inputs and returns one row's outputs (a tuple)."""

    make: Callable[[], object]
    inputs: Sequence[Column | str]
    outputs: int = 1
    #: The rows that an output depends on, itself included; None if all before it do.
    reach: int | None = None
    #: Of a smoother: alpha, n and start as in `kernels.Smoother`.
    smooth: tuple[float, int, int | None] | None = None
    #: Whether the object has state() and restore(), by a list of numbers, and tends to forget how it began.
    machine: bool = False


@dataclass
class Running:
    """An aggregate of each row's value and those of all rows before it; `how` is a name in `RUNNING`, nulls play no part."""

    how: str
    value: Column | str


@dataclass
class Since:
    """An aggregate of the values from the last row on for which `mask` is true; null before the first such row."""

    how: str
    mask: Column | str
    value: Column | str


@dataclass
class Place:
    """Where a row stands when its series is sorted by x, ties by the order column: "sort" 0-based, NaN first; "argsort" 0-based,
    NaN last; "rank" 1-based means of ties, NaN for NaN."""

    how: str
    x: Column | str


@dataclass
class Request:
    """A Running, Since or Place that an operator asked for: its fields as columns, the column to make, and how many rows the
    operator had looked back before."""

    how: str
    fields: dict[str, Column]
    out: str
    behind: int


@dataclass(frozen=True)
class Monoid:
    """An aggregate function of rows in order; `merge` aggregates its results, `join` joins two of them, which may be null."""

    of: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]

    def both(self, a: Column, b: Column) -> Column:
        return F.coalesce(self.join(a, b), b, a)


def _last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


RUNNING = {
    "sum": Monoid(F.sum, F.sum, lambda a, b: a + b),
    "product": Monoid(F.product, F.product, lambda a, b: a * b),
    "max": Monoid(F.max, F.max, F.greatest),
    "min": Monoid(F.min, F.min, F.least),
    "any": Monoid(F.bool_or, F.bool_or, lambda a, b: a | b),
    "count": Monoid(F.count_if, F.sum, lambda a, b: a + b),
    "last": Monoid(_last, _last, lambda a, b: b),
}


@dataclass
class Series:
    df: DataFrame
    keys: list[str]
    ord: str
    #: How many blocks a key's rows are cut into; None: 64 without keys, else 0, which cuts none.
    pieces: int | None = None
    #: For each run of state machines over a series in blocks: how many blocks had to be run again, round by round. Set by `compute`.
    reruns: list[list[int]] = field(default_factory=list, init=False)
    #: Names of temporary columns so far.
    made: int = field(default=0, init=False)
    #: The operator that `compute` is advancing, and how many rows each has looked back so far.
    now: str = field(default="", init=False)
    behind: dict[str, int] = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        self.w = Window.partitionBy(*self.keys).orderBy(self.ord)
        self.running = self.w.rowsBetween(Window.unboundedPreceding, 0)
        if self.pieces is None:
            self.pieces = 0 if self.keys else 64
        self.made = max((int(c[2:]) for c in self.df.columns if c.startswith("_t") and c[2:].isdigit()), default=0)

    # Window building blocks

    def index(self) -> Column:
        """0-based position."""
        return (F.row_number().over(self.w) - 1).cast("long")

    def frame(self, n: int):
        check_period(n)
        return self.between(1 - n, 0)

    def between(self, first: int, last: int):
        """The frame of rows from `first` to `last`, relative to each."""
        self._looks(-first)
        return self.w.rowsBetween(first, last)

    def lag(self, x) -> Column:
        """x of the row before, null for the first row."""
        self._looks(1)
        return F.lag(col(x)).over(self.w)

    def full(self, n: int) -> Column:
        """Whether a row is its series' n-th or later."""
        self._looks(n - 1)
        return F.row_number().over(self.w) >= n

    def total(self) -> Column:
        """Number of rows."""
        return F.count("*").over(Window.partitionBy(*self.keys))

    def _looks(self, rows: int) -> None:
        self.behind[self.now] = self.behind.get(self.now, 0) + max(0, rows)

    def warm(self, n: int, value: Column) -> Column:
        """value from the n-th row on, NaN before."""
        return F.when(F.row_number().over(self.w) >= n, or_nan(value)).otherwise(NAN)

    def back(self, x, k: int) -> Column:
        """x of k rows before (after, for k < 0); NaN outside."""
        x = col(x)
        self._looks(k)
        return x if k == 0 else or_nan((F.lag(x, k) if k > 0 else F.lead(x, -k)).over(self.w))

    def sum(self, x, n: int) -> Column:
        return self.warm(n, F.sum(col(x)).over(self.frame(n)))

    def mean(self, x, n: int) -> Column:
        return self.warm(n, F.avg(col(x)).over(self.frame(n)))

    def max(self, x, n: int) -> Column:
        return self.warm(n, F.max(col(x)).over(self.frame(n)))

    def min(self, x, n: int) -> Column:
        f = self.frame(n)
        return self.warm(n, F.when(F.bool_or(F.isnan(col(x))).over(f), NAN).otherwise(F.min(col(x)).over(f)))

    def agg(self, value: Column, n: int) -> Column:
        return self.warm(n, value.over(self.frame(n)))

    def window(self, x, n: int) -> Column:
        """The frame's values as an array, oldest first."""
        return F.collect_list(col(x)).over(self.frame(n))

    def weighted(self, x, weights: Sequence[float]) -> Column:
        """Sum of the last len(weights) values by weight, oldest first."""
        fixed = F.array(*[F.lit(float(v)) for v in weights])
        products = F.zip_with(self.window(x, len(weights)), fixed, lambda a, b: a * b)
        return self.warm(len(weights), F.aggregate(products, F.lit(0.0), lambda a, v: a + v))

    # Execution

    def compute(self, **operators: Callable[[Series], object] | Column) -> DataFrame:
        """df with a column for each operator, or `name_key` for each key of an operator that returns a dict."""
        results: dict[str, object] = {}
        waiting: dict[str, tuple[Generator, object]] = {}
        self.df = self.df.select(*self.df.columns)
        if self.pieces:
            from tidemill.operators.pieces import compute_long, divisible

            if divisible(self.df, self.ord):
                return compute_long(self, operators)
        keep = self.df.columns
        for name, op in operators.items():
            self.now = name
            made = op(self) if callable(op) else op
            if inspect.isgenerator(made):
                waiting[name] = (made, None)
            else:
                results[name] = made
        while waiting:
            asked: dict[str, object] = {}
            for name, (gen, value) in list(waiting.items()):
                self.now = name
                try:
                    asked[name] = gen.send(value)
                except StopIteration as end:
                    results[name] = end.value
                    del waiting[name]
            for name, value in self._provide(asked).items():
                waiting[name] = (waiting[name][0], value)
        out: dict[str, Column] = {}
        for name in operators:
            found = results[name]
            out |= {f"{name}_{k}": v for k, v in found.items()} if isinstance(found, dict) else {name: found}
        return self.df.select(*keep, *[v.alias(k) for k, v in out.items()])

    def _provide(self, asked: dict[str, object]) -> dict[str, object]:
        given: dict[str, object] = {}
        columns: dict[str, Column] = {}
        asked_kernels: dict[str, list[tuple[Kernel, list[str]]]] = {}
        ordered: list[tuple[Running | Since | Place, Request]] = []

        def named(c: Column | str) -> str:
            if isinstance(c, str):
                return c
            self.made += 1
            columns[f"_t{self.made}"] = c
            return f"_t{self.made}"

        for name, what in asked.items():
            several = isinstance(what, (list, tuple))
            own: list[object] = []
            for one in what if several else [what]:
                if isinstance(one, Kernel):
                    asked_kernels.setdefault(name, []).append((one, [named(c) for c in one.inputs]))
                    own.append(one)
                elif isinstance(one, (Running, Since, Place)):
                    fields = {k: F.col(named(v if isinstance(v, Column) else F.col(v))) for k, v in vars(one).items() if k != "how"}
                    self.made += 1
                    ordered.append((one, Request(one.how, fields, f"_t{self.made}", self.behind.get(name, 0))))
                    own.append(F.col(f"_t{self.made}"))
                else:
                    own.append(F.col(named(one)))
            given[name] = own if several else own[0]
        if columns:
            self.df = self.df.withColumns(columns)
        for kind, make in ((Running, self._scan), (Since, self._segments), (Place, self._place)):
            if wanted := [request for one, request in ordered if isinstance(one, kind)]:
                make(wanted)
        if asked_kernels:
            self._run([(*k, self.behind.get(name, 0)) for name, own in asked_kernels.items() for k in own], given)
            for name, own in asked_kernels.items():
                self.behind[name] = self.behind.get(name, 0) + sum((k.reach or 1) - 1 for k, _ in own)
        return given

    def _scan(self, wanted: list[Request]) -> None:
        self.df = self.df.withColumns({r.out: RUNNING[r.how].of(r.fields["value"]).over(self.running) for r in wanted})

    def _segments(self, wanted: list[Request]) -> None:
        self.df = self.df.withColumns({f"{r.out}_g": F.count_if(r.fields["mask"]).over(self.running) for r in wanted})
        for r in wanted:
            group = F.col(f"{r.out}_g")
            w = Window.partitionBy(*self.keys, group).orderBy(self.ord).rowsBetween(Window.unboundedPreceding, 0)
            self.df = self.df.withColumn(r.out, F.when(group > 0, RUNNING[r.how].of(r.fields["value"]).over(w)))

    def _place(self, wanted: list[Request]) -> None:
        for r in wanted:
            x = r.fields["x"]
            w = Window.partitionBy(*self.keys)
            if r.how == "rank":
                below = F.rank().over(w.orderBy(x))
                value = F.when(F.isnan(x), NAN).otherwise(below + (F.count("*").over(Window.partitionBy(*self.keys, x)) - 1) / F.lit(2.0))
            else:
                order = [F.isnan(x).desc()] if r.how == "sort" else []
                value = (F.row_number().over(w.orderBy(*order, x, self.ord)) - 1).cast("long")
            self.df = self.df.withColumn(r.out, value)

    def _run(self, wanted: list[tuple[Kernel, list[str], int]], given: dict[str, object]) -> None:
        names: dict[int, list[str]] = {}
        for kernel, _, _ in wanted:
            names[id(kernel)] = [f"_t{self.made + i + 1}" for i in range(kernel.outputs)]
            self.made += kernel.outputs
        self._kernels([(k, inputs, names[id(k)], behind) for k, inputs, behind in wanted])

        def settle(x: object) -> object:
            if isinstance(x, Kernel):
                out = [F.col(n) for n in names[id(x)]]
                return out[0] if len(out) == 1 else out
            return [settle(y) for y in x] if isinstance(x, list) else x

        for name in given:
            given[name] = settle(given[name])

    def _kernels(self, wanted: list[tuple[Kernel, list[str], list[str], int]]) -> None:
        self.df = run_kernels(self.df, self.keys, self.ord, [(k.make, inputs, outputs) for k, inputs, outputs, _ in wanted])


def check_period(n: int, least: int = 1, name: str = "period") -> None:
    if n < least:
        raise ValueError(f"{name} must be at least {least}, not {n}")


def run_kernels(df: DataFrame, keys: list[str], ord: str, wanted: list[tuple[Callable, list[str], list[str]]]) -> DataFrame:
    """df with the kernels' output columns (double): one shuffle by key, one sort, one pass in Arrow batches."""
    inputs = sorted({c for _, cols, _ in wanted for c in cols})
    outputs = [c for _, _, cols in wanted for c in cols]
    ready = df.withColumns({f"_in_{c}": nz(c) for c in inputs})
    ready = (ready.repartition(*keys) if keys else ready.coalesce(1)).sortWithinPartitions(*keys, ord)
    kept = df.columns
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outputs]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list = []
        for batch, cuts in key_runs(batches, keys):
            data = {c: batch.column(f"_in_{c}").to_numpy(zero_copy_only=False) for c in inputs}
            made: list[list[list[np.ndarray]]] = [[[] for _ in cols] for _, _, cols in wanted]
            for fresh, first, end in cuts:
                if fresh:
                    steps = [k if hasattr(k := make(), "run") else Rows(k) for make, _, _ in wanted]
                for step, (_, cols, _), into in zip(steps, wanted, made, strict=True):
                    for column, values in zip(into, step.run(*[data[c][first:end] for c in cols]), strict=True):
                        column.append(values)
            arrays = [batch.column(c) for c in kept] + [pa.array(np.concatenate(x)) for each in made for x in each]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *outputs])

    return ready.mapInArrow(run, schema)


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, int, int]]]]:
    """Of batches in which equal keys stand together: each batch with its runs (whether a new key begins, first row, end)."""
    now: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in keys]
        differs = np.zeros(n - 1, bool)
        for c in columns:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            differs |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
        first = tuple(c[0].as_py() for c in columns)
        yield batch, [(k > 0 or first != now, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        now = tuple(c[n - 1].as_py() for c in columns)


# Cumulative operators


def cum_sum(s: Series, x) -> Generator:
    return (yield Running("sum", col(x)))


def cum_prod(s: Series, x) -> Generator:
    return (yield Running("product", col(x)))


def cum_max(s: Series, x) -> Generator:
    return (yield Running("max", col(x)))


def cum_min(s: Series, x) -> Generator:
    bad, low = yield [Running("any", F.isnan(col(x))), Running("min", col(x))]
    return F.when(bad, NAN).otherwise(low)


def cum_count_true(s: Series, m) -> Generator:
    return (yield Running("count", col(m)))


def drawdown(s: Series, x) -> Generator:
    """(x - peak) / peak of the running maximum; NaN from the first NaN on and while the peak isn't positive."""
    peak = yield Running("max", col(x))
    return F.when(peak > 0, (col(x) - peak) / F.when(peak > 0, peak)).otherwise(NAN)


# Lags and signals


def shift(s: Series, x, lag: int) -> Column:
    """lag < 0 reads the future."""
    return s.back(x, lag)


def diff(s: Series, x, lag: int = 1) -> Column:
    return F.lit(0.0) if lag == 0 else col(x) - s.back(x, lag)


def rate(s: Series, x, n: int = 1) -> Column:
    """(x - base) / base, and 0 for a zero base."""
    check_period(n)
    base = s.back(x, n)
    return F.when(base == 0, 0.0).otherwise((col(x) - base) / F.when(base != 0, base))


def rising(s: Series, x, n: int) -> Column:
    check_period(n)
    before = s.back(x, n)
    return (col(x) > before) & no_nan(col(x), before)


def falling(s: Series, x, n: int) -> Column:
    check_period(n)
    before = s.back(x, n)
    return (col(x) < before) & no_nan(col(x), before)


def cross_over(s: Series, a, b) -> Column:
    a, b = col(a), col(b)
    a1, b1 = s.back(a, 1), s.back(b, 1)
    return (a1 <= b1) & (a > b) & no_nan(a, b, a1, b1)


def cross_under(s: Series, a, b) -> Column:
    return cross_over(s, b, a)


def cross(s: Series, a, b) -> Column:
    """+1, -1 or 0."""
    return F.when(cross_over(s, a, b), 1).when(cross_under(s, a, b), -1).otherwise(0).cast("byte")


def bars_since(s: Series, m) -> Generator:
    """Rows since the last true, -1 before the first."""
    rows = yield Since("count", col(m), F.lit(True))
    return (F.coalesce(rows, F.lit(0)) - 1).cast("long")


def value_when(s: Series, m, x) -> Generator:
    """x at the last true row, which may be NaN; NaN before the first."""
    held = yield Running("last", F.when(col(m), F.struct(col(x).alias("x"))))
    return or_nan(held["x"])


def highest_since(s: Series, m, x) -> Generator:
    return or_nan((yield Since("max", col(m), col(x))))


def lowest_since(s: Series, m, x) -> Generator:
    bad, low = yield [Since("any", col(m), F.isnan(col(x))), Since("min", col(m), col(x))]
    return F.when(bad, NAN).otherwise(or_nan(low))


# Orders and ranks


def sort_copy(s: Series, x) -> Generator:
    """Position in ascending order, NaN first: order by it to sort. Ties go by the order column."""
    return (yield Place("sort", col(x)))


def argsort(s: Series, x) -> Generator:
    """Position in stable ascending order, NaN last."""
    return (yield Place("argsort", col(x)))


def rank(s: Series, x) -> Generator:
    """1-based average ranks; NaN has none and counts for none."""
    return (yield Place("rank", col(x)))


def reverse(s: Series, x) -> Generator:
    """The value that stands here when the series is read backwards: a join by key and mirrored position."""
    i, n = yield [s.index(), s.total()]
    s.made += 1
    value, mirror = f"_v{s.made}", f"_m{s.made}"
    right = s.df.select(*[F.col(k).alias(f"{mirror}_{j}") for j, k in enumerate(s.keys)], (n - 1 - i).alias(mirror), col(x).alias(value))
    same = i == F.col(mirror)
    for j, k in enumerate(s.keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{mirror}_{j}"))
    s.df = s.df.join(right, same, "left")
    return F.col(value)


# Rolling windows: kernels whose time doesn't grow with the period (order statistics excepted)


def _moving(n: int, value: Callable[..., np.ndarray], *inputs) -> Kernel:
    check_period(n)
    count = len(inputs)
    return Kernel(lambda: kernels.Window(n, value, count), list(inputs), reach=n)


def sum_kernel(x, n: int) -> Kernel:
    return _moving(n, kernels.moving_sum, x)


def mean_kernel(x, n: int) -> Kernel:
    return _moving(n, lambda v, n: kernels.moving_sum(v, n) / n, x)


def weighted_kernel(x, weights: Sequence[float]) -> Kernel:
    """The sum of the last len(weights) values by weight, oldest first."""
    fixed = np.array(weights, np.float64)
    return _moving(len(fixed), lambda v, _: kernels.moving_weighted(v, fixed), x)


def wma_kernel(x, n: int) -> Kernel:
    check_period(n)
    return weighted_kernel(x, [2 * (j + 1) / (n * (n + 1)) for j in range(n)])


def correlation_kernel(x, y, n: int) -> Kernel:
    return _moving(n, kernels.moving_correlation, x, y)


def covariance_kernel(x, y, n: int, less: int = 0) -> Kernel:
    return _moving(n, lambda v, w, n: kernels.moving_covariance(v, w, n, less), x, y)


def variance_kernel(x, n: int, less: int = 0) -> Kernel:
    return _moving(n, lambda v, n: kernels.moving_variance(v, n, less), x)


def max_kernel(x, n: int) -> Kernel:
    return _moving(n, kernels.moving_max, x)


def min_kernel(x, n: int) -> Kernel:
    return _moving(n, kernels.moving_min, x)


def std_dev_kernel(x, n: int, less: int = 0) -> Kernel:
    return _moving(n, lambda v, n: np.sqrt(kernels.moving_variance(v, n, less)), x)


def rolling_sum(s: Series, x, n: int) -> Generator:
    return (yield sum_kernel(x, n))


def rolling_mean(s: Series, x, n: int) -> Generator:
    return (yield mean_kernel(x, n))


def rolling_max(s: Series, x, n: int) -> Generator:
    return (yield max_kernel(x, n))


def rolling_min(s: Series, x, n: int) -> Generator:
    return (yield min_kernel(x, n))


def rolling_range(s: Series, x, n: int) -> Generator:
    return (yield _moving(n, lambda v, n: kernels.moving_max(v, n) - kernels.moving_min(v, n), x))


def rolling_wma(s: Series, x, n: int) -> Generator:
    return (yield wma_kernel(x, n))


def rolling_variance(s: Series, x, n: int) -> Generator:
    return (yield _moving(n, kernels.moving_variance, x))


def rolling_variance_sample(s: Series, x, n: int) -> Generator:
    return (yield _moving(n, lambda v, n: kernels.moving_variance(v, n, 1), x))


def rolling_std_dev(s: Series, x, n: int) -> Generator:
    return (yield std_dev_kernel(x, n))


def rolling_std_dev_sample(s: Series, x, n: int) -> Generator:
    return (yield std_dev_kernel(x, n, 1))


def rolling_covariance(s: Series, x, y, n: int) -> Generator:
    return (yield _moving(n, kernels.moving_covariance, x, y))


def rolling_covariance_sample(s: Series, x, y, n: int) -> Generator:
    return (yield _moving(n, lambda v, w, n: kernels.moving_covariance(v, w, n, 1), x, y))


def rolling_correlation(s: Series, x, y, n: int) -> Generator:
    return (yield correlation_kernel(x, y, n))


def rolling_quantile(s: Series, x, n: int, q: float) -> Generator:
    """Exact, by linear interpolation."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    by_ranks = n > LONG_ORDER
    return (yield _moving(n, lambda v, n: kernels.moving_quantile(v, n, q, by_ranks), x))


def rolling_median(s: Series, x, n: int) -> Generator:
    return rolling_quantile(s, x, n, 0.5)


def percent_rank_kernel(x, n: int) -> Kernel:
    by_ranks = n > LONG_ORDER
    return _moving(n, lambda v, n: kernels.moving_percent_rank(v, n, by_ranks), x)


def abs_deviation_kernel(x, n: int) -> Kernel:
    """The mean distance from the window's mean."""
    by_ranks = n > LONG_ORDER
    return _moving(n, lambda v, n: kernels.moving_abs_deviation(v, n, by_ranks), x)


def rolling_percent_rank(s: Series, x, n: int) -> Generator:
    """100 * share of the window's n values below the newest."""
    return (yield percent_rank_kernel(x, n))


# Recursive smoothers


def smoother(alpha: float, n: int, start: int | None = 0) -> Callable[[], kernels.Smoother]:
    return lambda: kernels.Smoother(alpha, n, start)


def ema_kernel(x, n: int, start: int | None = 0) -> Kernel:
    check_period(n)
    return Kernel(smoother(2 / (n + 1), n, start), [x], smooth=(2 / (n + 1), n, start))


def rma_kernel(x, n: int, start: int | None = 0) -> Kernel:
    check_period(n)
    return Kernel(smoother(1 / n, n, start), [x], smooth=(1 / n, n, start))


def _smoothed(s: Series, x, n: int, alpha: float, pieces: int | None) -> Generator:
    """`pieces` cuts the series for this smoother alone; one that is cut into blocks already needs none."""
    check_period(n)
    if not pieces or type(s) is not Series:
        return (yield Kernel(smoother(alpha, n), [x], smooth=(alpha, n, 0)))
    from tidemill.operators.scan import smooth_long

    values = yield col(x)
    s.made += 2
    name, out = f"_x{s.made}", f"_y{s.made}"
    s.df = smooth_long(s.df.withColumn(name, values), s.keys, s.ord, name, alpha, n, out, pieces).drop(name)
    return F.col(out)


def rolling_ema(s: Series, x, n: int, pieces: int | None = None) -> Generator:
    return _smoothed(s, x, n, 2 / (n + 1), pieces)


def rolling_rma(s: Series, x, n: int, pieces: int | None = None) -> Generator:
    return _smoothed(s, x, n, 1 / n, pieces)


def compress(df: DataFrame, mask: Column | str) -> DataFrame:
    """The rows where the mask is true, in their order."""
    return df.where(col(mask))
