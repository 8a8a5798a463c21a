"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's lines are its paragraphs; about 8 of them form a section, which ends after a paragraph whose hash ends in three
zero bits. Paragraphs have leaves below them: pieces of whole words, about four, each ending after
a word whose hash ends in two zero bits, so an edit changes the pieces that it touches and no others. A parent's hash covers
its children's, and the root covers also the text's length and bytes, so equal roots mean equal texts. The fingerprint holds
root and leaves; inner hashes follow from the leaves, and `differences` descends only into branches whose hashes differ.

Fingerprint: root (32 hex digits), then for each section "/" and its paragraphs joined by ",", a paragraph being its pieces'
hashes of six characters (36 bits). Null and empty texts have a root and no leaves. Likeness is the share of leaves in
common (twice the common ones, with multiplicity, over all); without leaves on either side it is 1 for equal roots, else 0.

Rows of equal doc_id go by text, and all return; a null doc_id goes first; repeated rows are each other's next documents, the
only row of a table is its own. An empty table gives no rows. Columns other than doc_id and text, whatever their names, are
ignored. A very long text costs time and memory in proportion to itself."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import pick, sliced
from tidemill.llm._text import NOT_BLANK, mix, words

_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
WIDTH = 6
#: Words of a piece at most; the next cut by content brings shifted pieces back into step.
LONGEST = 6


def _codes(hashes: np.ndarray) -> str:
    """Six characters for each hash."""
    shifts = np.arange(58, 58 - 6 * WIDTH, -6, dtype=np.uint64)
    return _LETTERS[((hashes[:, None] >> shifts) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[str | None]) -> list[str]:
    whole = [t or "" for t in texts]
    # Words are hashed in their own case: another case is another text.
    column = pa.array(whole, pa.large_string())
    hashes, bounds, starts, ends = words(column, NOT_BLANK, fold=False)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)  # the paragraph of each word, counted over all texts
    out = []
    raw = [t.encode("utf-8", "surrogatepass") for t in whole]
    if len(hashes):
        new_line = np.append(True, line[1:] != line[:-1])
        last = np.append(new_line[1:], True)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        piece_end = last | (hashes & np.uint64(3) == 0)
        firsts = np.flatnonzero(np.append(True, piece_end[:-1]))
        within = np.arange(len(hashes)) - np.repeat(firsts, np.diff(np.append(firsts, len(hashes))))
        piece_end |= within % LONGEST == LONGEST - 1
        firsts = np.flatnonzero(np.append(True, piece_end[:-1]))
        pieces = _sums(hashes, firsts)
        ends_at = np.flatnonzero(piece_end)
        piece_last = last[ends_at]
        first_piece = np.flatnonzero(np.append(True, piece_last[:-1]))
        paragraphs = _sums(pieces, first_piece)
        closes = paragraphs & np.uint64(7) == 0
        piece_bounds = np.searchsorted(ends_at, bounds, "left")
        paragraph_bounds = np.searchsorted(first_piece, piece_bounds)
        codes = _codes(pieces)
    for i, own in enumerate(raw):
        root = hashlib.blake2b(own, digest_size=16).hexdigest()
        parts = [root]
        if len(hashes) and paragraph_bounds[i] < paragraph_bounds[i + 1]:
            a, b = int(paragraph_bounds[i]), int(paragraph_bounds[i + 1])
            edges = first_piece[a:b].tolist() + [int(piece_bounds[i + 1])]
            bodies = [codes[WIDTH * x : WIDTH * y] for x, y in zip(edges, edges[1:], strict=False)]
            section: list[str] = []
            for body, close in zip(bodies, closes[a:b].tolist(), strict=True):
                section.append(body)
                if close:
                    parts.append(",".join(section))
                    section = []
            if section:
                parts.append(",".join(section))
        leaves = "/".join(parts[1:])
        out.append(_root(root, leaves) + ("/" + leaves if leaves else ""))
    return out


def _sums(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A hash over the order and values of each run of children that begins at firsts."""
    at = np.arange(len(hashes)) - np.repeat(firsts, np.diff(np.append(firsts, len(hashes))))
    return mix(np.add.reduceat(mix(hashes + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), firsts))


def _node(children: list[str]) -> str:
    return hashlib.blake2b("|".join(children).encode(), digest_size=16).hexdigest()


def _root(content: str, leaves: str) -> str:
    """The root over the sections' hashes and the text's own."""
    return _node([content, *[_node(s.split(",")) for s in leaves.split("/")]])


def _leaves(fingerprint: str) -> np.ndarray:
    body = fingerprint[32:].replace("/", "").replace(",", "").encode()
    return np.frombuffer(body, f"S{WIDTH}") if body else np.zeros(0, f"S{WIDTH}")


def likeness(a: str, b: str) -> float:
    if a[:32] == b[:32]:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    if not len(x) or not len(y):
        return 0.0
    (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    common = np.minimum(m, n[at])[v[at] == u].sum()
    return float(2 * common / (len(x) + len(y)))


def _aligned(mine: list[str], theirs: list[str]) -> list[tuple[int, int, int, int]]:
    """What two lists of hashes don't have in common, in order: (first, end, first there, end there). Equal ends are taken
    off; between them, hashes that both hold once are matched in the longest order that both share."""
    first = 0
    while first < min(len(mine), len(theirs)) and mine[first] == theirs[first]:
        first += 1
    tail = 0
    while tail < min(len(mine), len(theirs)) - first and mine[-1 - tail] == theirs[-1 - tail]:
        tail += 1
    a, b = range(first, len(mine) - tail), range(first, len(theirs) - tail)
    once = Counter(mine[i] for i in a)
    place = {theirs[j]: j for j in b}
    there = Counter(theirs[j] for j in b)
    pairs = [(i, place[mine[i]]) for i in a if once[mine[i]] == 1 and there[mine[i]] == 1]
    ends: list[int] = []  # of the best run of each length, by its last place there
    best: list[tuple[int, int]] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(best[at - 1][1] if at else -1)
        if at == len(ends):
            ends.append(j)
            best.append((j, k))
        else:
            ends[at], best[at] = j, (j, k)
    matched, k = [], best[-1][1] if best else -1
    while k >= 0:
        matched.append(pairs[k])
        k = back[k]
    out, i, j = [], first, first
    for x, y in [*reversed(matched), (len(mine) - tail, len(theirs) - tail)]:
        if i < x or j < y:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the paragraphs of a that have no counterpart in b. Only sections whose hashes differ are looked
    into, and sections and paragraphs are aligned by hash, so what an insertion has moved isn't named."""
    if a[:32] == b[:32]:
        return []
    mine, theirs = ([s.split(",") for s in x.split("/")[1:]] for x in (a, b))
    places = [(i, k) for i, section in enumerate(mine) for k in range(len(section))]
    begins = np.cumsum([0, *[len(s) for s in mine]]).tolist()
    out = []
    for first, end, there, until in _aligned([_node(s) for s in mine], [_node(s) for s in theirs]):
        own = [p for s in mine[first:end] for p in s]
        for x, y, _, _ in _aligned(own, [p for s in theirs[there:until] for p in s]):
            out += places[begins[first] + x : begins[first] + y]
    return out


def located(a: str, b: str) -> str:
    """The differing paragraphs of a as ranges "section.paragraph-section.paragraph", joined by commas."""
    found = differences(a, b)
    sizes = [s.count(",") + 1 for s in a.split("/")[1:]]
    runs: list[list[tuple[int, int]]] = []
    for place in found:
        if runs and place in ((runs[-1][1][0], runs[-1][1][1] + 1), (runs[-1][1][0] + 1, 0)) and (place[1] or runs[-1][1][1] + 1 == sizes[runs[-1][1][0]]):
            runs[-1][1] = place
        else:
            runs.append([place, place])
    return ",".join(f"{x[0]}.{x[1]}" + (f"-{y[0]}.{y[1]}" if y != x else "") for x, y in runs)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row's whole text; no shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([pick(batch, "doc_id"), pa.array(fingerprints(pick(batch, "text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fingerprint string")


_LOWEST = -(2**63)


def _in_parts(docs: DataFrame, rows_each: int, most_parts: int) -> DataFrame:
    """(part, own, key, doc_id, text), dealt by part and in order: parts hold consecutive doc_ids (null first; rows of equal
    doc_id go by text), each followed by the first row of the next part, the last by the first of all (own = false).
    The bounds are ids that occur, found on the id column alone; the driver sees one id for each of at most most_parts parts.
    A part is a partition of its own; it is sorted there, with spilling, and read in batches, so it may be of any size."""
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"))
    count = ids.count()
    wanted = min(max(1, -(-count // rows_each)), most_parts)
    shares = F.array(*[F.lit(k / wanted) for k in range(1, wanted)]) if wanted > 1 else F.array(F.lit(0.5))
    lowest, found = ids.agg(F.min("key"), F.percentile_approx("key", shares, 10 * wanted + 100)).first()
    bounds = np.array(sorted({b for b in found or [] if b > lowest} if wanted > 1 else set()), np.int64)
    begins = np.concatenate([[lowest if lowest is not None else 0], bounds])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pick(batch, "key").to_numpy()
            part = np.searchsorted(bounds, key, "right")
            first = np.flatnonzero(begins[part] == key)
            rows = np.concatenate([np.arange(len(key)), first])
            parts = np.concatenate([part, (part[first] - 1) % len(begins)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int64)), pa.array(np.arange(len(rows)) < len(key)), *[pick(taken, c) for c in ("key", "doc_id", "text")]],
                ["part", "own", "key", "doc_id", "text"],
            )

    keyed = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = keyed.mapInArrow(place, "part long, own boolean, key long, doc_id long, text string")
    return placed.repartitionById(len(begins), F.col("part").cast("int")).sortWithinPartitions("part", F.desc("own"), "key", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the next text's first (or all of them)."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_edits(docs: DataFrame, rows_each: int = 1000, most_parts: int = 4096) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and edited_at (the paragraphs that the edit has changed or removed, see `located`), where the next document is
    that of the next larger doc_id (after the last: the first). Texts are shuffled once, into parts of about rows_each rows,
    or larger ones if that makes more than most_parts; a task holds a few megabytes of them at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, None  # the part, and its last row: (doc_id, text, fingerprint, own)
        for batch in sliced(batches, "text"):
            parts = pick(batch, "part").to_pylist()
            texts = pick(batch, "text").to_pylist()
            prints = fingerprints(texts)
            pairs = []
            for part, row in zip(parts, zip(pick(batch, "doc_id").to_pylist(), texts, prints, pick(batch, "own").to_pylist(), strict=True), strict=True):
                if part != now:
                    now, waiting = part, None
                if waiting and waiting[3]:
                    pairs.append((waiting, row))
                waiting = row
            changed = [edited(a[1], b[1]) for a, b in pairs]
            new = fingerprints(changed)
            columns = [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([a[2] for a, _ in pairs], pa.string()),
                pa.array(new, pa.string()),
                pa.array([likeness(a[2], e) for (a, _), e in zip(pairs, new, strict=True)], pa.float64()),
                pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                pa.array([located(a[2], e) for (a, _), e in zip(pairs, new, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_at"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at string"
    return _in_parts(own, rows_each, most_parts).mapInArrow(run, schema)
