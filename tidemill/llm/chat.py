"""Chat formatting with relational operations and Spark expressions only.

Format: each run of turns of one role is a block

    <turn ROLE>\\nTEXT<part>TEXT...</turn>\\n

Control strings inside roles and texts (the backslash, "<turn ", "</turn>", "<part>", and in roles also ">") get a backslash
in front, so every text can be read back: `unescaped` takes off one backslash of each pair, from left to right. "<part>"
keeps the turns of a merged block apart.

Rows are range-partitioned by (conv_id, turn, role, text), so a conversation with a third of all rows spreads over many
tasks, and are collected, sorted and merged in segments of at most `segment` successive turns. A conversation's segments, in
order, are its formatted text; a segment that goes on with the role of the one before continues its block. What meets in one
task by conversation is a number and two roles for each segment. No value grows with a conversation's length, but for the
digests of `read_back`, which reads a conversation's segments one after the other as SHA-256 has to. loss_spans are the code point spans, in a segment's text, of the escaped assistant texts.

Null texts and roles are empty; a null turn goes first; equal turns go by role, then text; repeated rows stay. Rows with a
null conv_id form one conversation. Other columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import materialize, pick

_CONTROL = r"(\\|<turn |</turn>|<part>)"
_CONTROL_IN_ROLE = r"(\\|<turn |</turn>|<part>|>)"
_ESCAPED = re.compile(r"\\(\\|<turn |</turn>|<part>|>)")


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, _CONTROL_IN_ROLE if role else _CONTROL, r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_conversations(turns: DataFrame, segment: int = 128, loss_role: str = "assistant", partitions: int | None = None) -> DataFrame:
    """conv_id, segment (0, 1, ...), n_turns, formatted, loss_spans (array of (start, end))."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    count = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # A conversation's rows have successive numbers within a partition; partitions follow one another by the high bits.
    packed = placed.groupBy("conv_id", F.shiftright("at", 33).alias("piece"), F.floor(F.col("at") / segment).alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns")
    )
    merged = packed.select(
        "conv_id",
        "piece",
        "group",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), _merge).alias("blocks"),
    )
    # Written once: both the neighbours' roles and the texts come from it, and a second run might cut segments elsewhere.
    merged = materialize(merged.withColumns({"first": F.element_at("blocks", 1)["role"], "last": F.element_at("blocks", -1)["role"]}), "chat-segments")
    # Only roles of segments meet by conversation, which is less than a hundredth of the rows and none of the texts.
    w = Window.partitionBy("conv_id").orderBy("group")
    places = merged.select(
        F.col("conv_id").alias("conv"),
        F.col("group").alias("own"),
        (F.row_number().over(w) - 1).cast("long").alias("segment"),
        F.lag("last").over(w).alias("before"),
        F.lead("first").over(w).alias("after"),
    )
    linked = merged.join(places, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("group") == F.col("own"))).select("conv_id", "segment", "n_turns", "blocks", "before", "after")
    pieces = linked.withColumn("pieces", F.flatten(F.transform("blocks", lambda b, i: _pieces(b, i, loss_role))))
    pieces = pieces.withColumn("starts", _starts(F.col("pieces")))
    return pieces.select(
        "conv_id",
        "segment",
        "n_turns",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform(
            F.filter(F.arrays_zip("pieces", "starts"), lambda z: z["pieces"]["loss"]),
            lambda z: F.struct(z["starts"].alias("start"), (z["starts"] + F.length(z["pieces"]["text"])).alias("end")),
        ).alias("loss_spans"),
    )


def _merge(blocks: Column, turn: Column) -> Column:
    last = F.get(blocks, F.size(blocks) - 1)
    longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
    fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    same = (F.size(blocks) > 0) & (last["role"] == turn["role"])
    return F.when(same, F.array_append(F.slice(blocks, F.lit(1), F.size(blocks) - 1), longer)).otherwise(F.array_append(blocks, fresh))


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _pieces(block: Column, i: Column, loss_role: str) -> Column:
    no = F.lit(False)
    goes_on = (i == 0) & F.col("before").eqNullSafe(block["role"])
    stays_open = (i == F.size("blocks") - 1) & F.col("after").eqNullSafe(block["role"])
    head = F.when(goes_on, "<part>").otherwise(F.concat(F.lit("<turn "), escaped(block["role"], role=True), F.lit(">\n")))
    tail = F.when(stays_open, "").otherwise("</turn>\n")
    texts = F.flatten(
        F.transform(block["texts"], lambda t, k: F.array(_piece(F.when(k == 0, head).otherwise("<part>"), no), _piece(escaped(t), block["role"] == loss_role)))
    )
    return F.array_append(texts, _piece(tail, no))


def _starts(pieces: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    return F.aggregate(
        pieces, zero, lambda a, p: F.struct((a["at"] + F.length(p["text"])).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")), lambda a: a["starts"]
    )


_MARK = re.compile(r"\\(?:\\|<turn |</turn>|<part>|>)|<turn ((?:[^\\>]|\\.)*)>\n|</turn>\n|<part>", re.S)


class Reader:
    """Reads formatted segments of one conversation back, turn by turn, with the digests of op1's contract."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.role = ""

    def read(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        at = None  # where the present turn's text begins
        for m in _MARK.finditer(formatted):
            if m[0][0] == "\\":
                continue
            if at is not None:
                self._turn(formatted[at : m.start()])
            if m[1] is not None:
                self.role = unescaped(m[1])
            at = None if m[0] == "</turn>\n" else m.end()
        if at is not None:  # the block goes on in the next segment
            self._turn(formatted[at:])
        for span in spans:
            text = unescaped(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def _turn(self, text: str) -> None:
        self.turns += 1
        self.digest.update(f"{self.role}\n{unescaped(text)}\n".encode("utf-8", "surrogatepass"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from format_conversations' rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Segments come sorted to a task, which reads them one after the other and holds one at a time."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done = None, None, []
        for batch in batches:
            columns = (pick(batch, c).to_pylist() for c in ("conv_id", "segment", "formatted", "loss_spans"))
            for conv, segment, text, spans in zip(*columns, strict=True):
                if segment == 0:
                    if reader:
                        done.append((now, reader))
                    now, reader = conv, Reader()
                reader.read(text, spans)
            yield _digests(done)
            done = []
        yield _digests([(now, reader)] if reader else [])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([c for c, _ in done], pa.int64()),
            pa.array([r.turns for _, r in done], pa.int64()),
            pa.array([r.digest.hexdigest() for _, r in done], pa.string()),
            pa.array([r.loss_chars for _, r in done], pa.int64()),
            pa.array([r.loss.hexdigest() for _, r in done], pa.string()),
            pa.array([r.chars for _, r in done], pa.int64()),
        ],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )
