"""Long series over many tasks: each key's rows are cut into blocks of equal length, which are worked on alone.

Rows get their position first: the order column's range is cut at quantiles, rows are counted in each part, and a row's
position is the count of the parts before it and its place in its own. A block is `size` positions in a row, size being a key's
rows over `pieces`, and holds besides, as halo, the last rows of the block before it (and the first of the next, for operators
that look ahead). So what depends on a bounded number of rows needs its block alone: window frames, lags and kernels run on
blocks as they run on keys, and the halo's own results are dropped at the end. How many rows an operator reaches back
is found by running it on an empty series that only counts; for operators built on operators the counts add up.

What depends on all rows before it is a scan. An ordered aggregate (`Running`) reduces each block's rows to one value, merges
these in order over the blocks before, and joins the result to what it finds within the block; `Since` does so with a mark for
the last row that begins anew, and smoothers with affine maps, whose seed needs a few rows by value. Operators may look back
at a scan's results, so a block's halo has right ones too: each block is reduced in two parts, up to and from the halo of the next.
If what is scanned has itself looked back, it isn't known in so many first rows of a halo; these count as before it. Reductions are aggregates that Spark combines before any shuffle; what meets in one task
is a row for each block of a key.

Places in a sort cut the range of values instead, so that equal values never meet in two parts; a value that fills parts by
itself has a part of its own, which is cut by the order column. Kernels that branch on their own last result run on guesses
(`machines`); other recurrences stay with one task for each key."""

from __future__ import annotations

import math
import re
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, NumericType, StructField, StructType, TimestampNTZType, TimestampType

from tidemill.functions.ieee import NAN, nz
from tidemill.operators.kernels import Smoother, fixed_scan
from tidemill.operators.series import RUNNING, Kernel, Request, Series, key_runs

_TIMES = (DateType, TimestampNTZType, TimestampType)


def divisible(df: DataFrame, ord: str) -> bool:
    return isinstance(df.schema[ord].dataType, (NumericType, *_TIMES))


def _number(df: DataFrame, ord: str) -> Column:
    timed = isinstance(df.schema[ord].dataType, _TIMES)
    return F.unix_micros(F.col(ord).cast("timestamp")).cast("double") if timed else F.col(ord).cast("double")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, with its lineage cut. A local session without one gets one of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if named := df.sparkSession.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(named)
        elif not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint()


def cuts_of(df: DataFrame, number: Column, pieces: int) -> list[float]:
    """Values that cut all rows into about equal parts, with repeats where one value fills several."""
    if pieces < 2:
        return []
    found = df.agg(F.percentile_approx(number, [i / pieces for i in range(1, pieces)], 50 * pieces)).first()[0]
    return sorted(found or [])


def part_of(number: Column, cuts: list[float]) -> Column:
    """How many cuts are at or below a number: a tree of comparisons. None is below for a null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number >= F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def beside(rows: DataFrame, few: DataFrame, by: list[str], single: bool) -> DataFrame:
    """rows with the other columns of few, which has one row for each value of `by`. `single`: the series has no keys, so few
    has no more rows than there are parts, and is broadcast."""
    named = few.select(*[F.col(k).alias(f"_same{i}") for i, k in enumerate(by)], *[c for c in few.columns if c not in by])
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_same{i}"))
    return rows.join(F.broadcast(named) if single else named, same).drop(*[f"_same{i}" for i in range(len(by))])


def expand(df: DataFrame, keys: list[str], ord: str, back: int, ahead: int, pieces: int) -> DataFrame:
    """df's rows in blocks, those of halos more than once, with _block, _pos (in the series), _side (-1, 0, 1: in the halo before, the
    block, the halo behind) and _lead (place among the last `back` rows of the block that is its own, else -1)."""
    number = _number(df, ord)
    at = df.withColumn("_part", part_of(number, cuts_of(df, number, pieces)))
    by = Window.partitionBy(*keys)
    counts = at.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select(*keys, "_part", before.alias("_before"), F.sum("_n").over(by).alias("_all"))
    placed = beside(at, counts, [*keys, "_part"], not keys)
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(ord)) - 1
    placed = placed.withColumn("_pos", (F.col("_before") + place).cast("long"))
    size = F.greatest(F.lit(back), F.lit(ahead), F.ceil(F.col("_all") / pieces), F.lit(1)).cast("long")
    block, last = F.floor(F.col("_pos") / size).cast("long"), F.floor((F.col("_all") - 1) / size)
    placed = placed.withColumns({"_home": block, "_at": F.pmod(F.col("_pos"), size), "_size": size, "_last": last})
    tail = F.col("_at") >= F.col("_size") - back
    home = F.col("_home")
    copies = F.array(home)
    if back:
        copies = F.concat(copies, F.when(tail & (home < F.col("_last")), F.array(home + 1)).otherwise(F.array().cast("array<long>")))
    if ahead:
        copies = F.concat(copies, F.when((F.col("_at") < ahead) & (home > 0), F.array(home - 1)).otherwise(F.array().cast("array<long>")))
    dealt = placed.withColumns({"_lead": F.when(tail, F.col("_at") - (F.col("_size") - back)).otherwise(-1), "_block": F.explode(copies)})
    return dealt.select(*df.columns, "_block", "_pos", (home - F.col("_block")).cast("int").alias("_side"), F.col("_lead").cast("long").alias("_lead"))


class Probe(Series):
    """Runs an operator on an empty series: how many rows it looks back (`behind`) and ahead, and whether all that it asks for can
    be had by blocks."""

    def __init__(self, df: DataFrame, keys: list[str], ord: str):
        super().__init__(df.sparkSession.createDataFrame([], df.schema), keys, ord, pieces=0)
        self.ahead, self.by_blocks = 0, True

    def between(self, first: int, last: int):
        self.ahead += max(0, last)
        return super().between(first, last)

    def back(self, x, k: int) -> Column:
        self.ahead += max(0, -k)
        return super().back(x, k)

    def total(self) -> Column:
        self.by_blocks = False
        return super().total()

    def _place(self, wanted: list[Request]) -> None:
        self.by_blocks = False
        super()._place(wanted)

    def _kernels(self, wanted: list[tuple[Kernel, list[str], list[str], int]]) -> None:
        self.by_blocks &= all(k.reach is not None or k.smooth is not None or k.machine for k, _, _, _ in wanted)
        self.df = self.df.withColumns({c: F.lit(NAN) for _, _, outputs, _ in wanted for c in outputs})


class Whole(Series):
    """A series as it is, whose places in a sort are found by parts of the values."""

    def __init__(self, df: DataFrame, keys: list[str], ord: str, parts: int):
        super().__init__(df, keys, ord, pieces=0)
        self.parts = parts

    def _place(self, wanted: list[Request]) -> None:
        for r in wanted:
            self.df = placed(self.df, self.keys, self.ord, r.fields["x"], r.how, r.out, self.parts)


class Blocks(Series):
    """An expanded series; `keys` are those of blocks, `outer` those of the series."""

    def __init__(self, expanded: DataFrame, outer: list[str], ord: str):
        super().__init__(expanded, [*outer, "_block"], ord, pieces=0)
        self.outer, self.scans = outer, 0

    def _cut(self) -> None:
        """A scan reads its rows twice; from the second one on what it reads is written first, or the work would double each time."""
        if self.scans:
            self.df = checkpointed(self.df)
        self.scans += 1

    def index(self) -> Column:
        return F.col("_pos")

    def _scan(self, wanted: list[Request]) -> None:
        self._cut()
        by = Window.partitionBy(*self.outer).orderBy("_block")
        earlier = by.rowsBetween(Window.unboundedPreceding, -2)

        def reduced(how: str, value: Column, part: Column) -> Column:
            if how == "last":  # by position, as aggregates have no order
                return F.max_by(value, F.when(part & value.isNotNull(), F.col("_pos")))
            return RUNNING[how].of(F.when(part, value))

        few = self.df.groupBy(*self.outer, "_block").agg(*[reduced(r.how, r.fields["value"], part).alias(f"{r.out}_{k}") for r in wanted for k, part in _sides(r.behind).items()])
        carried = [RUNNING[r.how].both(RUNNING[r.how].merge(F.col(f"{r.out}_t")).over(earlier), F.lag(f"{r.out}_h").over(by)).alias(f"{r.out}_c") for r in wanted]
        self.df = beside(self.df, few.select(*self.outer, "_block", *carried), self.keys, not self.outer)
        local = {r.out: RUNNING[r.how].of(F.when(_known(r.behind), r.fields["value"])).over(self.running) for r in wanted}
        self.df = self.df.withColumns({r.out: RUNNING[r.how].both(F.col(f"{r.out}_c"), local[r.out]) for r in wanted})

    def _segments(self, wanted: list[Request]) -> None:
        self._cut()
        by = Window.partitionBy(*self.outer).orderBy("_block")
        later = Window.partitionBy(*self.keys).orderBy(F.desc(self.ord)).rowsBetween(Window.unboundedPreceding, -1)
        # Rows of a part behind its last mark have no marks later on.
        marks = self.df.withColumns({f"{r.out}_l{k}": F.coalesce(F.count_if(part & r.fields["mask"]).over(later), F.lit(0)) for r in wanted for k, part in _sides(r.behind).items()})
        sums, segments, merged, carried = [], {}, {}, []
        for r in wanted:
            one, name = RUNNING[r.how], r.out
            for k, part in _sides(r.behind).items():
                last = part & (F.col(f"{name}_l{k}") == 0)
                sums += [F.coalesce(F.bool_or(part & r.fields["mask"]), F.lit(False)).alias(f"{name}_b{k}"), one.of(F.when(last, r.fields["value"])).alias(f"{name}_v{k}")]
            # Blocks up to the next that has a mark are one segment.
            segments[f"{name}_s"] = F.sum(F.col(f"{name}_bt").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
            w = Window.partitionBy(*self.outer, f"{name}_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
            merged[f"{name}_m"] = F.when(F.col(f"{name}_s") > 0, one.merge(F.col(f"{name}_vt")).over(w))
            begun, held = F.coalesce(F.lag(F.col(f"{name}_s") > 0, 2).over(by), F.lit(False)), F.lag(f"{name}_m", 2).over(by)
            anew, fresh = F.coalesce(F.lag(f"{name}_bh").over(by), F.lit(False)), F.lag(f"{name}_vh").over(by)
            carried += [(anew | begun).alias(f"{name}_o"), F.when(anew, fresh).when(begun, one.both(held, fresh)).alias(f"{name}_c")]
        few = marks.groupBy(*self.outer, "_block").agg(*sums).withColumns(segments).withColumns(merged).select(*self.outer, "_block", *carried)
        joined = beside(self.df, few, self.keys, not self.outer)
        joined = joined.withColumns({f"{r.out}_g": F.count_if(_known(r.behind) & r.fields["mask"]).over(self.running) for r in wanted})
        results = {}
        for r in wanted:
            group = F.col(f"{r.out}_g")
            w = Window.partitionBy(*self.keys, group).orderBy(self.ord).rowsBetween(Window.unboundedPreceding, 0)
            value = RUNNING[r.how].of(F.when(_known(r.behind), r.fields["value"])).over(w)
            results[r.out] = F.when(group > 0, value).when(F.col(f"{r.out}_o"), RUNNING[r.how].both(F.col(f"{r.out}_c"), value))
        self.df = joined.withColumns(results)

    def _kernels(self, wanted: list[tuple[Kernel, list[str], list[str], int]]) -> None:
        if near := [w for w in wanted if w[0].reach is not None]:
            super()._kernels(near)
        far: dict[int, list] = {}
        machines: dict[int, list] = {}
        for kernel, inputs, outputs, behind in wanted:
            if kernel.machine:
                machines.setdefault(behind, []).append((kernel.make, inputs, outputs))
            elif kernel.reach is None:
                far.setdefault(behind, []).append((kernel.smooth, inputs[0], outputs[0]))
        for behind, some in far.items():
            self._cut()
            self.df = _smoothed(self.df, self.outer, self.ord, some, behind)
        for behind, some in machines.items():
            from tidemill.operators.machines import run_machines

            self.scans += 1
            self._cut()
            self.df, again = run_machines(self.df, self.outer, self.ord, some, behind)
            self.reruns.append(again)


def _sides(behind: int) -> dict[str, Column]:
    """The parts that a block is reduced in: t, all rows, and h, those that the next block doesn't begin with. It begins with its
    halo, but for the first `behind` rows, in which what is scanned isn't known."""
    own = F.col("_side") == 0
    return {"t": own, "h": own & (F.col("_lead") < behind)}


def _known(behind: int) -> Column:
    return (F.col("_side") >= 0) | (F.col("_lead") >= behind)


def _saved(s: Smoother) -> list[float]:
    """Rows still to wait for (-1: up to a valid value), values seen, their sum and its lost part, the last result."""
    return [-1.0 if s.wait is None else float(s.wait), float(s.seen), s.total, s.lost, s.value]


def _restored(alpha: float, n: int, state: list[float]) -> Smoother:
    s = Smoother(alpha, n, None if state[0] < 0 else int(state[0]))
    s.seen, s.total, s.lost, s.value = int(state[1]), state[2], state[3], state[4]
    return s


class _Part:
    """What a smoother needs of a part of a block: how many rows, whether it begins with NaN that a late start skips, the rows
    that may belong to the seed, and the affine map of the rest."""

    def __init__(self, alpha: float, n: int, start: int | None):
        self.alpha, self.late, self.room = alpha, start is None, n + (start or 0)
        self.rows, self.skipped, self.head, self.rest, self.shift = 0, 0, [], 0, 0.0

    def take(self, x: np.ndarray) -> None:
        self.rows += len(x)
        if self.late and not self.head and not self.rest:
            valid = np.flatnonzero(x == x)
            first = int(valid[0]) if len(valid) else len(x)
            self.skipped, x = self.skipped + first, x[first:]
        free = self.room - len(self.head)
        self.head += x[:free].tolist()
        if len(x) > free:
            self.rest += len(x) - free
            self.shift = float(fixed_scan(x[free:], self.alpha, self.shift)[-1])

    def values(self) -> list[float]:
        return [float(self.skipped), float(self.rest), self.shift, *self.head]


def _advance(s: Smoother, part: list[float]) -> None:
    skipped, rest, shift, head = part[0], int(part[1]), part[2], part[3:]
    if skipped and s.wait is not None:
        s.run(np.array([NAN]))
    if head:
        s.run(np.array(head))
    if rest:
        s.value = (1 - s.alpha) ** rest * s.value + shift


def _smoothed(df: DataFrame, outer: list[str], ord: str, wanted: list[tuple[tuple[float, int, int | None], str, str]], behind: int) -> DataFrame:
    """df with each wanted smoother's output: parts are reduced, chained key by key, and rows filled in from the states."""
    by, columns = [*outer, "_block"], df.columns
    rows = df.withColumns({f"{out}_x": nz(x) for _, x, out in wanted} | {"_tail": F.col("_lead") >= behind})
    inputs, outs = [f"{out}_x" for _, _, out in wanted], [out for _, _, out in wanted]
    setups = [setup for setup, _, _ in wanted]
    fields = {f.name: f for f in df.schema.fields}
    lists = ArrayType(ArrayType(DoubleType()))

    def made(keys: list[tuple], tails: list, values: list, schema: pa.Schema, tail: bool) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in keys], schema.field(c).type) for i, c in enumerate(by)]
        arrays += [pa.array(tails, pa.bool_())] if tail else []
        return pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.list_(pa.list_(pa.float64())))], [*by, *(["_tail"] if tail else []), "_values"])

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, schema = None, [], None
        for batch, runs in key_runs(batches, [*by, "_tail"]):
            schema, done = batch.schema, []
            for fresh, first, end in runs:
                if fresh:
                    done += [(key, parts)] if key is not None else []
                    key, parts = tuple(batch.column(k)[first].as_py() for k in [*by, "_tail"]), [_Part(*s) for s in setups]
                for part, c in zip(parts, inputs, strict=True):
                    part.take(batch.column(c)[first:end].to_numpy(zero_copy_only=False))
            yield made([k[:-1] for k, _ in done], [k[-1] for k, _ in done], [[p.values() for p in own] for _, own in done], schema, True)
        if key is not None:
            yield made([key[:-1]], [key[-1]], [[p.values() for p in parts]], schema, True)

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[Smoother] = []
        block, came, following = None, None, None
        for batch, runs in key_runs(batches, outer):
            keys, values, given = [], [], batch.column("_values")
            blocks, tails = batch.column("_block").to_pylist(), batch.column("_tail").to_pylist()
            for fresh, first, end in runs:
                if fresh:
                    states, block = [Smoother(*s) for s in setups], None
                    following = [_saved(s) for s in states]
                for i in range(first, end):
                    if blocks[i] != block:
                        block, came = blocks[i], following
                        keys.append((*[batch.column(k)[i].as_py() for k in outer], block))
                        values.append(came)
                    if tails[i]:  # the next block begins with these rows
                        following = [_saved(s) for s in states]
                    for s, part in zip(states, given[i].as_py(), strict=True):
                        _advance(s, part)
                    if not tails[i]:
                        following = [_saved(s) for s in states]
            yield made(keys, [], values, batch.schema, False)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[Smoother] = []
        for batch, runs in key_runs(batches, [*by, "_row"]):
            real, results = batch.column("_row").to_numpy(zero_copy_only=False), [[] for _ in outs]
            for fresh, first, end in runs:
                if real[first] == 1:  # in the halo, before its values are known
                    for into in results:
                        into.append(np.full(end - first, NAN))
                    continue
                if not real[first]:
                    states = [_restored(a, n, v) for (a, n, _), v in zip(setups, batch.column("_values")[first].as_py(), strict=True)]
                    continue
                for s, c, into in zip(states, inputs, results, strict=True):
                    into.append(s.run(batch.column(c)[first:end].to_numpy(zero_copy_only=False))[0])
            kept = batch.filter(pa.array(real > 0))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], *[pa.array(np.concatenate([np.zeros(0), *r])) for r in results]], [*columns, *outs])

    summary = StructType([*[fields[k] for k in by], StructField("_tail", BooleanType()), StructField("_values", lists)])
    own = rows.where("_side = 0").select(*by, "_tail", ord, *inputs).repartition(*by).sortWithinPartitions(*by, ord)
    few = own.mapInArrow(reduce, summary)
    few = (few.repartition(*outer) if outer else few.coalesce(1)).sortWithinPartitions(*by, "_tail")
    states = few.mapInArrow(chain, StructType([*[fields[k] for k in by], StructField("_values", lists)])).withColumn("_row", F.lit(0))
    both = rows.withColumn("_row", F.when(_known(behind), 2).otherwise(1)).unionByName(states, allowMissingColumns=True)
    ready = both.repartition(*by).sortWithinPartitions(*by, "_row", ord)  # what isn't known comes before what is
    return ready.mapInArrow(fill, StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outs]]))


def placed(df: DataFrame, keys: list[str], ord: str, x: Column, how: str, out: str, pieces: int) -> DataFrame:
    """df with column `out`, as `Place` says: rows are dealt by the range of their values."""
    value = F.when(~F.isnan(x), x)
    cuts = cuts_of(df, value, pieces)
    # A value at which two cuts fall fills a part: it is cut off from the values above it.
    full = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    edges = sorted({*cuts, *[c for v in full for c in (v, math.nextafter(v, math.inf)) if c < math.inf]})
    many = [bisect_right(edges, v) for v in full]
    bad = -1 if how == "sort" else len(edges) + 1
    part = F.when(F.isnan(x), F.lit(bad)).otherwise(part_of(x, edges))
    number = _number(df, ord) if divisible(df, ord) else None
    sub = F.when(part.isin([*many, bad]), part_of(number, cuts_of(df, number, pieces))).otherwise(F.lit(0)) if number is not None else F.lit(0)
    at = df.withColumns({f"{out}_p": part, f"{out}_s": sub})
    by = [*keys, f"{out}_p", f"{out}_s"]
    few = at.groupBy(*by).agg(F.count("*").alias(f"{out}_n"))
    w = Window.partitionBy(*keys).orderBy(f"{out}_p", f"{out}_s")
    before = F.sum(f"{out}_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{out}_n")
    whole = Window.partitionBy(*keys, f"{out}_p")
    few = few.withColumn(f"{out}_b", before).withColumns({f"{out}_a": F.min(f"{out}_b").over(whole), f"{out}_c": F.sum(f"{out}_n").over(whole)})
    at = beside(at, few, by, not keys)
    own = Window.partitionBy(*by)
    if how == "rank":
        within = F.rank().over(own.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)
        within = F.when(F.col(f"{out}_p").isin(many), (F.col(f"{out}_c") + 1) / F.lit(2.0)).otherwise(within)
        found = F.when(F.isnan(x), NAN).otherwise(F.col(f"{out}_a") + within)
    else:
        found = (F.col(f"{out}_b") + F.row_number().over(own.orderBy(x, ord)) - 1).cast("long")
    return at.withColumn(out, found).select(*df.columns, out)


def compute_long(series: Series, operators: dict[str, object]) -> DataFrame:
    """`Series.compute` of a series that is cut into blocks."""
    keep, back, ahead = series.df.columns, 0, 0
    blocks: dict[str, object] = {}
    whole: dict[str, object] = {}
    names: dict[str, list[str]] = {}
    for name, op in operators.items():
        probe = Probe(series.df, series.keys, series.ord)
        names[name] = [c for c in probe.compute(**{name: op}).columns if c not in keep]
        if probe.by_blocks:
            back, ahead = max(back, *probe.behind.values(), 0), max(ahead, probe.ahead)
            blocks[name] = op
        else:
            whole[name] = op
    df = series.df
    if whole:
        df = Whole(df, series.keys, series.ord, series.pieces).compute(**whole)
    if blocks:
        expanded = expand(df, series.keys, series.ord, back, ahead, series.pieces)
        cut = Blocks(expanded, series.keys, series.ord)
        df = cut.compute(**blocks).where("_side = 0").drop("_block", "_pos", "_side", "_lead")
        series.reruns = cut.reruns
    return df.select(*keep, *[c for name in operators for c in names[name]])
