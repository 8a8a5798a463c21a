"""State machines on series in blocks. What a machine does next depends on its own last results, so blocks can't be reduced and merged;
but it forgets how it began: after some rows its state is the same from wherever it came. So each block is run on a guess.

First every block is run from the machine's beginning, then again from the state in which the block before ended. A block whose
start still differs from its neighbour's end is run once more, round by round, until none does; then rows are filled in. All
starts are then the true ones, whatever the guesses were, so results equal those of one task to the last bit. A machine that
forgets within a block is done after the second run; in the worst case a block settles in each round.

Rounds read the blocks that are left, from a written table; what they hand on is two states for each block."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemill.functions.ieee import NAN, nz
from tidemill.operators.pieces import beside, checkpointed
from tidemill.operators.series import key_runs

_STATES = ArrayType(ArrayType(DoubleType()))


def run_machines(df: DataFrame, outer: list[str], ord: str, wanted: list[tuple[Callable, list[str], list[str]]], behind: int) -> tuple[DataFrame, list[int]]:
    """An expanded series with the machines' outputs, and how many blocks had to be run again in each round after the second
    run. Inputs aren't known in the first `behind` rows of a block's halo. df is read several times."""
    by, columns = [*outer, "_block"], df.columns
    inputs, outs = sorted({c for _, cols, _ in wanted for c in cols}), [c for _, _, cols in wanted for c in cols]
    fields = {f.name: f for f in df.schema.fields}
    keyed = StructType([fields[k] for k in by])
    side, lead = F.col("_side"), F.col("_lead")
    rows = df.withColumns({f"_in_{c}": nz(c) for c in inputs})

    def started(states: list | None) -> list:
        made = [make() for make, _, _ in wanted]
        for machine, state in zip(made, states or [], strict=bool(states)):
            machine.restore(state)
        return made

    def values(batch: pa.RecordBatch, first: int, end: int) -> dict[str, np.ndarray]:
        return {c: batch.column(f"_in_{c}")[first:end].to_numpy(zero_copy_only=False) for c in inputs}

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block's start (row 0) and rows: the start and the state after them."""
        key, start, machines, schema = None, None, [], None

        def made(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([k[i] for k, _, _ in done], schema.field(c).type) for i, c in enumerate(by)]
            lists = pa.list_(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*arrays, pa.array([s for _, s, _ in done], lists), pa.array([e for _, _, e in done], lists)], [*by, "_start", "_end"])

        for batch, runs in key_runs(batches, by):
            schema, done = batch.schema, []
            real = batch.column("_row")
            for fresh, first, end in runs:
                if fresh:
                    if key is not None:
                        done.append((key, start, [m.state() for m in machines]))
                    key = tuple(batch.column(k)[first].as_py() for k in by)
                    start = None if real[first].as_py() else batch.column("_start")[first].as_py()
                    machines = started(start)
                    first += not real[first].as_py()
                if first < end:
                    x = values(batch, first, end)
                    for machine, (_, cols, _) in zip(machines, wanted, strict=True):
                        machine.run(*[x[c] for c in cols])
            yield made(done)
        if key is not None:
            yield made([(key, start, [m.state() for m in machines])])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, given = [], None
        for batch, runs in key_runs(batches, [*by, "_row"]):
            real = batch.column("_row").to_numpy(zero_copy_only=False)
            results: list[list[np.ndarray]] = [[] for _ in outs]
            for fresh, first, end in runs:
                if fresh and real[first] != 1:
                    key = repr([batch.column(k)[first].as_py() for k in by])
                    if not real[first]:
                        given = (key, batch.column("_start")[first].as_py())
                    else:
                        machines = started(given[1] if given and given[0] == key else None)
                if not real[first]:
                    continue
                x = values(batch, first, end)
                # In the halo, before inputs are known, there are no results.
                made = [y for m, (_, cols, _) in zip(machines, wanted, strict=True) for y in m.run(*[x[c] for c in cols])] if real[first] == 2 else [np.full(end - first, NAN)] * len(outs)
                for into, y in zip(results, made, strict=True):
                    into.append(y)
            kept = batch.filter(pa.array(real > 0))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], *[pa.array(np.concatenate([np.zeros(0), *r])) for r in results]], [*columns, *outs])

    def with_starts(some: DataFrame, states: DataFrame) -> DataFrame:
        both = some.unionByName(states.select(*by, "_start", F.lit(0).alias("_row")), allowMissingColumns=True)
        return both.repartition(*by).sortWithinPartitions(*by, "_row", ord)

    # What the next block begins with, its halo, isn't part of what leads to its start.
    known: Column = (side >= 0) | (lead >= behind)
    leading = rows.where(((side == -1) & (lead >= behind)) | ((side == 0) & (lead < behind)))
    leading = leading.select(*by, ord, *[f"_in_{c}" for c in inputs], F.lit(2).alias("_row"))
    ended = StructType([*keyed.fields, StructField("_start", _STATES), StructField("_end", _STATES)])
    none = leading.where("false").select(*by, F.lit(None).cast(_STATES).alias("_start"))
    few = checkpointed(with_starts(leading, none).mapInArrow(ends, ended))
    before = F.lag("_end").over(Window.partitionBy(*outer).orderBy("_block"))
    again: list[int] = []
    while True:
        linked = few.withColumn("_came", before).withColumn("_off", ~F.col("_start").eqNullSafe(F.col("_came")))
        off = linked.where("_off").select(*by, F.col("_came").alias("_start"))
        if not (count := off.count()):
            break
        again.append(count)
        left = beside(leading, off.select(*by), by, not outer)
        rerun = with_starts(left, off).mapInArrow(ends, ended)
        few = checkpointed(linked.where("not _off").select(*by, "_start", "_end").unionByName(rerun))
    real = rows.withColumn("_row", F.when(known, 2).otherwise(1))
    filled = with_starts(real, few).mapInArrow(fill, StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in outs]]))
    return filled, again[1:]
