"""Pieces that several operators of this subpackage use: shared storage, null handling, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in which intermediate tables go: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    folder of its own; a cluster gets an error, as its machines share no temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The open `scratch` blocks' tables.
_scratch: list[list[str]] = []


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts lineage: a lost executor costs no more
    than the tasks that read it. Files go at the end of a `scratch` block that is open (not with `keep`); without one they
    stay until the folder is cleaned, as checkpoint files do."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write in this block are deleted at its end; what is to last has to be written before that."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_table(spark, path)


def shared_file(spark: SparkSession, path: str):
    """A new file that the driver writes to: has write(bytearray) and close()."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)


def drop_tables_of(df: DataFrame) -> None:
    """Deletes the folders of the files that df reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_table(df.sparkSession, path)


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pick(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliced(batches: Iterable[pa.RecordBatch], column: str, target: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `target` bytes of `column` (or one row), which bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(pick(batch, column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > target:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def connected_components(edges: DataFrame, tag: str = "cc", limit: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (a, b long); component is the smallest node that links reach.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    longest path, until links form stars; no further round is needed to see that. Each round is written to the shared
    folder. Nodes and links stay distributed; the driver sees one count a round. Self-loops and repeated links are
    allowed; no links give no rows."""
    now = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )

    def settled(df: DataFrame) -> bool:
        """Whether each u has one link, to a v that is no u."""
        ends = F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("up")), F.struct(F.col("v").alias("node"), F.lit(False).alias("up")))
        held = df.select(F.inline(ends)).groupBy("node").agg(F.count_if("up").alias("links"), F.bool_and("up").alias("alone"))
        return not held.agg(F.count_if(F.expr("links > 1 or links = 1 and not alone"))).first()[0]

    for _ in range(limit):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u != v")
            .distinct()
        )
        following = materialize(small, tag)
        drop_tables_of(now)
        now = following
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Of batches in which equal keys stand together: each key (long, not null) with its rows. Holds one key's rows."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pick(batch, key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            if held and keys[first] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[first]
            held.append(batch.slice(first, end - first))
    if held:
        yield now, pa.Table.from_batches(held)
