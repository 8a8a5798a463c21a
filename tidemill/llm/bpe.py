"""Byte-level BPE encoding and decoding through a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and every two neighbours u, t
are compatible, that is, the bytes of u followed by t encode to [u, t]. Each prefix of a text has one such sequence. The
merges thus compile into a non-deterministic automaton whose hypotheses are (tokens since the last one emitted, trie node
of the token being read). `Transducer` determinises it on demand: a state is the set of live hypotheses, and a token is
emitted as soon as all of them agree on it. A hypothesis lives no longer than a vocabulary entry, which bounds lookahead.

As the tiktoken library does, a piece that is itself in the vocabulary gives that id, and pieces are the matches of the
split pattern; all other pieces, of any length, go through the transducer. Nulls and empty texts give no ids. Texts of any
length take time in proportion to their length. Rows are independent, so repeated rows and equal ids get equal results, an
empty table gives no rows, and columns other than doc_id and text, whatever their names, play no part."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice
from marshal import dumps, loads

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import pick, sliced
from tidemill.llm._table import Table, spread

#: White space as Unicode's White_Space has it; the regex module's own class also holds U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with white space as Unicode defines it."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
            i += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{_SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return regex.compile("".join(out))


def compile_latin(pattern: str) -> re.Pattern | None:
    """The same pattern for texts within U+0000 to U+00FF, by the faster standard module: classes are written out."""
    of = {
        kind: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind) for kind in "LN"
    }
    blanks = r"\t-\r \x85\xa0"
    out = pattern.replace(r"\S", f"[^{blanks}]")
    for name, members in ((r"\p{L}", of["L"]), (r"\p{N}", of["N"]), (r"\s", blanks)):
        out = "".join(
            part if not i else (members if _inside_class(out_before) else f"[{members}]") + part
            for i, part, out_before in _parts(out, name)
        )
    return None if r"\p" in out else re.compile(out)


def _parts(text: str, name: str) -> Iterator[tuple[int, str, str]]:
    before = ""
    for i, part in enumerate(text.split(name)):
        yield i, part, before
        before += part


def _inside_class(before: str) -> bool:
    bare = re.sub(r"\\.", "", before)
    return bare.rfind("[") > bare.rfind("]")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(ranks: dict[bytes, int], piece: bytes, below: int = 1 << 60) -> list[int]:
    """The defining procedure: joins the neighbours of the lowest rank, leftmost first, until none is left below `below`.
    Parts are named by their first byte; the heap holds (rank, part, its end, the next part's end) as they were when seen."""
    end = list(range(1, len(piece) + 1))
    before = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def propose(i: int) -> None:
        if i >= 0 and end[i] < len(piece):
            rank = ranks.get(piece[i : end[end[i]]])
            if rank is not None and rank < below:
                heappush(heap, (rank, i, end[i], end[end[i]]))

    for i in range(len(piece) - 1):
        propose(i)
    while heap:
        _, i, middle, last = heappop(heap)
        if end[i] != middle or end[middle] != last:
            continue
        end[i], end[middle] = last, -1
        if last < len(piece):
            before[last] = i
        propose(i)
        propose(before[i])
    out, at = [], 0
    while at < len(piece):
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Transducer:
    """Deterministic states are made when first needed. After `most` states the table starts afresh with those in use.

    A state is (node, paths): node is the longest suffix of the bytes read that begins a vocabulary entry, and paths has, for
    each suffix of it that does so too, longest first, and for the empty one, the tokens before that suffix: the last one
    emitted (START before any), then those that aren't emitted yet. A move is (state, byte) -> (state, output); an output is
    a run of tokens that all paths have come to agree on. No path outlives the vocabulary entry that it waits for, so a
    token is emitted after at most that many bytes more.

    `encode_pieces` steps many pieces at once, a byte of each: moves are looked up by numpy in one table. A piece without
    company, such as the end of one much longer than the rest, is stepped by itself through the same moves."""

    START = -1
    #: Pieces that go together; so many at least, else one by one.
    TOGETHER, FEW = 16384, 6

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks, self.most = ranks, most
        self.token_bytes = {r: b for b, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.terminal = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.terminal)
                    self.terminal.append(-1)
                node = self.child[key]
            self.terminal[node] = rank
        self.compatible_pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int]] = {}
        self.suffixes: dict[int, tuple[int, ...]] = {0: (0,)}
        self.steps: dict[int, tuple[int, tuple, tuple]] = {}
        self.forget()

    def forget(self) -> None:
        """Starts afresh, with no states and outputs."""
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_ids: dict[tuple[int, ...], int] = {(): 0}
        self._restart([])

    def _restart(self, keep: list[bytes]) -> list[int]:
        """Forgets all states but the start and `keep`, whose new numbers it gives. Outputs stay."""
        #: Packed by marshal, which takes a quarter of the memory.
        self.states: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        #: By state << 8 | byte the number of a move: `moves` for pieces that go alone, `table` for those that go together.
        self.moves: dict[int, int] = {}
        self.table = Table()
        #: By number of a move: the state that it leads to (-1: nowhere) and its output.
        self.to, self.emits = array("q"), array("q")
        self.start = self._state(dumps((0, ((self.START,),)), 2))
        return [self._state(s) for s in keep]

    def _state(self, state: bytes) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def _rest(self, state: int) -> tuple[int, ...]:
        """The tokens that are still to come if the piece ends here."""
        return loads(self.states[state])[1][-1][1:]

    def _output(self, tokens: tuple[int, ...]) -> int:
        found = self.output_ids.get(tokens)
        if found is None:
            found = self.output_ids[tokens] = len(self.outputs)
            self.outputs.append(tokens)
        return found

    def _step(self, node: int, byte: int) -> tuple[int, tuple, tuple]:
        """Where a byte leads from a node; for each suffix but the empty one there, which suffix here it comes from; and
        (suffix here, token) of each token that ends with the byte, longest first."""
        came, going, done = [], [], []
        for i, suffix in enumerate(self.suffixes[node]):
            following = self.child.get(suffix << 8 | byte)
            if following is not None:
                came.append(i)
                going.append(following)
                if self.terminal[following] >= 0:
                    done.append((i, self.terminal[following]))
        to = going[0] if going else 0
        self.suffixes.setdefault(to, (*going, 0) if going else (0,))
        step = self.steps[node << 8 | byte] = to, tuple(came), tuple(done)
        return step

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge on the way to `token` joins; (token, token) for a byte or an unreachable one."""
        found = self.splits.get(token)
        if found is None:
            parts = merge(self.ranks, self.token_bytes[token], below=token)
            found = self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens stay apart: going back through the merges of both, latest first, no merge across the
        boundary has a lower rank than the merge that next changes the boundary's side. first: START at a text's start."""
        key = first << 32 | second
        found = self.compatible_pairs.get(key)
        if found is None:
            if len(self.compatible_pairs) > 300_000:
                self.compatible_pairs.clear()
            found = self.compatible_pairs[key] = self._whole(second) and (first < 0 or self._apart(first, second))
        return found

    def _whole(self, token: int) -> bool:
        return len(self.token_bytes[token]) == 1 or self._split(token)[0] != token

    def _apart(self, left: int, right: int) -> bool:
        ranks, token_bytes, limit = self.ranks, self.token_bytes, 1 << 60
        while True:
            joined = ranks.get(token_bytes[left] + token_bytes[right])
            if joined is not None and joined < limit:
                return False
            inner, outer = self._split(left)[1], self._split(right)[0]
            undo_left, undo_right = inner != left, outer != right
            if not undo_left and not undo_right:
                return True
            # Undo the later of the two merges. A merge on the left goes before one of equal rank on the right.
            if undo_left and (left > right or not undo_right):
                limit, left = left, inner
            else:
                limit, right = right + 1, outer

    def _make(self, keys: list[int]) -> range:
        """Makes the moves of states and bytes (key: state << 8 | byte) and gives their numbers."""
        states, ids, steps, known = self.states, self.ids, self.steps, self.compatible_pairs
        outputs, output_ids, to_all, emit_all = self.outputs, self.output_ids, self.to, self.emits
        first = len(to_all)
        for key in keys:
            node, paths = loads(states[key >> 8])
            to, came, ends = steps.get(node << 8 | key & 255) or self._step(node, key & 255)
            for i, token in ends:
                path = paths[i]
                fits = known.get(path[-1] << 32 | token)
                if fits or fits is None and self.compatible(path[-1], token):
                    break
            else:  # the vocabulary isn't closed under its merges: no compatible sequence
                to_all.append(-1)
                emit_all.append(0)
                continue
            done = (*path, token)
            if came:
                going = [paths[i] for i in came]
                going.append(done)
                agreed = 0
                for a, b in zip(min(going), max(going), strict=False):
                    if a != b:
                        break
                    agreed += 1
                state = dumps((to, tuple([p[agreed - 1 :] for p in going] if agreed > 1 else going)), 2)
            else:
                agreed = len(done)
                state = dumps((to, ((token,),)), 2)
            number = ids.get(state)
            if number is None:
                number = ids[state] = len(states)
                states.append(state)
            to_all.append(number)
            spoken = done[1:agreed]
            number = output_ids.get(spoken)
            if number is None:
                number = output_ids[spoken] = len(outputs)
                outputs.append(spoken)
            emit_all.append(number)
        return range(first, len(to_all))

    def _alone(self, piece: bytes, state: int) -> list[int] | None:
        """The tokens from `state` on, to the end of the piece, or None if there are none."""
        out: list[int] = []
        moves, to, emits, outputs = self.moves, self.to, self.emits, self.outputs
        for at, byte in enumerate(piece):
            number = moves.get(state << 8 | byte)
            if number is None:
                if len(self.states) > self.most:
                    (state,) = self._restart([self.states[state]])
                    moves, to, emits = self.moves, self.to, self.emits
                number = moves[state << 8 | byte] = self._make([state << 8 | byte])[0]
            state = to[number]
            if state < 0:
                return None
            if emits[number]:
                out += outputs[emits[number]]
        return out + list(self._rest(state))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out = self._alone(piece, self.start)
        return merge(self.ranks, piece) if out is None else out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one piece after the other, and the pieces' offsets in them."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        parts = [self._together([pieces[i] for i in order[at : at + self.TOGETHER]]) for at in range(0, len(order), self.TOGETHER)]
        tokens = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in parts]])
        counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = np.cumsum(counts) - counts
        bounds = np.concatenate([[0], np.cumsum(counts[back])])
        return tokens[spread(starts[back], counts[back])], bounds

    def _moves_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the moves of all keys lead, and their outputs; makes those that are missing."""
        number = self.table.get(keys)
        missing = number < 0
        if missing.any():
            new = np.unique(keys[missing])
            self.table.put(new, np.array(self._make(new.tolist()), np.int32))
            number = self.table.get(keys)
        to, emits = np.frombuffer(self.to, np.int64)[number], np.frombuffer(self.emits, np.int64)[number]
        return to, emits

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces in descending length: their tokens, one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.cumsum(sizes) - sizes
        if max(len(self.states), len(self.outputs)) > self.most:
            self.forget()
        state = np.full(len(pieces), self.start, np.int64)
        rows, outputs, alone = [], [], {}

        def use(out: np.ndarray, row: np.ndarray) -> None:
            spoken = np.flatnonzero(out)
            if len(spoken):
                rows.append(row[spoken])
                outputs.append(out[spoken])

        every = np.arange(len(pieces))
        for i in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -i, "left"))  # pieces longer than i come first
            if m < self.FEW:
                break
            if len(self.states) > self.most:
                used = np.unique(state[state >= 0])
                fresh = np.zeros(int(used.max(initial=0)) + 1, np.int64)
                fresh[used] = self._restart([self.states[s] for s in used.tolist()])
                state = np.where(state >= 0, fresh[np.maximum(state, 0)], -1)
            live = np.flatnonzero(state[:m] >= 0)
            state[live], out = self._moves_of(state[live] << 8 | text[at[live] + i])
            use(out, live)
        else:
            i = int(sizes[0])
        # What is left: final tokens of pieces read to their end, the rest of long pieces, pieces without a sequence.
        last, of_row = np.unique(state, return_inverse=True)
        ends = np.array([self._output(self._rest(s)) if s >= 0 else 0 for s in last.tolist()], np.int64)[of_row]
        longer = [r for r in np.flatnonzero(sizes > i).tolist() if state[r] >= 0]
        ends[longer] = 0
        use(ends, every)
        row = np.concatenate([np.zeros(0, np.int64), *rows])
        number = np.concatenate([np.zeros(0, np.int64), *outputs])
        by_row = np.argsort(row, kind="stable")
        row, (numbers, number) = row[by_row], np.unique(number[by_row], return_inverse=True)
        spoken = [self.outputs[k] for k in numbers.tolist()]
        lengths = np.array([len(x) for x in spoken], np.int64)
        each = lengths[number]
        tokens = np.array(list(chain.from_iterable(spoken)), np.int64)[spread((np.cumsum(lengths) - lengths)[number], each)]
        counts = np.bincount(row, each, minlength=len(pieces)).astype(np.int64)
        states = [self.states[state[r]] for r in longer]
        for r, s in zip(longer, states, strict=True):
            alone[r] = self._alone(pieces[r][i:], self._state(s))
        for r in np.flatnonzero(state < 0).tolist():
            alone[r] = None
        if alone:
            bounds = np.concatenate([[0], np.cumsum(counts)])
            parts, done = [], 0
            for r in sorted(alone):
                own, more = tokens[bounds[r] : bounds[r + 1]], alone[r]
                whole = np.array(merge(self.ranks, pieces[r]), np.int64) if more is None else np.concatenate([own, np.array(more, np.int64)])
                parts += [tokens[done : bounds[r]], whole]
                done, counts[r] = int(bounds[r + 1]), len(whole)
            tokens = np.concatenate([*parts, tokens[done:]])
        return tokens, counts


class Utf8Stream:
    """Incremental UTF-8: feed() takes bytes, gives the text that is complete and keeps the rest of a code point."""

    #: By the leading five bits of a byte: the length of the sequence that it begins, 0 for a continuation.
    LENGTH = [1] * 16 + [0] * 8 + [2] * 4 + [3] * 2 + [4, 1]

    def __init__(self, errors: str = "replace"):
        self.rest, self.errors = b"", errors

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            need = self.LENGTH[data[-back] >> 3]
            if need:
                if need > back:
                    cut -= back
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", self.errors)


class Codec:
    """encode() and decode() of whole texts, and of columns of texts."""

    def __init__(self, raw_ranks: bytes, pattern: str):
        ranks = read_ranks(raw_ranks)
        self.transducer = Transducer(ranks)
        self.split_any, latin = compile_pattern(pattern).findall, compile_latin(pattern)
        self.split_latin = latin.findall if latin else None
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = pa.array(tokens, pa.large_binary())
        self.token_names = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())

    def split(self, text: str) -> list[str]:
        if self.split_latin:
            try:
                text.encode("latin-1")
                return self.split_latin(text)
            except UnicodeEncodeError:
                pass
        return self.split_any(text)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one piece after the other, and the pieces' offsets in them. A piece that is in the
        vocabulary has that id."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        known = np.array([self.transducer.ranks.get(p, -1) for p in raw], np.int64)
        new = np.flatnonzero(known < 0)
        tokens, bounds = self.transducer.encode_pieces([raw[i] for i in new.tolist()])
        counts = np.ones(len(raw), np.int64)
        counts[new] = np.diff(bounds)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.repeat(known, counts)
        out[spread(offsets[new], counts[new])] = tokens
        return out, offsets

    def encode(self, text: str | None) -> list[int]:
        """One text, piece by piece."""
        run = self.transducer.encode
        return list(chain.from_iterable([run(p.encode("utf-8", "surrogatepass")) for p in self.split(text or "")]))

    def decode_stream(self, ids: Iterable[int], step: int = 8192) -> Iterator[str]:
        """Text as it becomes complete; `step` ids at a time."""
        stream, token_bytes = Utf8Stream(), self.transducer.token_bytes
        ids = iter(ids)
        while some := list(islice(ids, step)):
            yield stream.feed(b"".join([token_bytes[t] for t in some]))
        if rest := stream.close():
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def encode_column(self, texts: list[str | None]) -> pa.LargeListArray:
        """The ids of each text."""
        numbers: defaultdict[str, int] = defaultdict()  # of the distinct pieces
        numbers.default_factory = numbers.__len__
        bounds, at = np.zeros(len(texts) + 1, np.int64), []
        for i, text in enumerate(texts):
            at.append(np.array([numbers[p] for p in self.split(text)] if text else [], np.int64))
            bounds[i + 1] = bounds[i] + len(at[-1])
        at = np.concatenate([np.zeros(0, np.int64), *at])
        tokens, offsets = self.encode_pieces(list(numbers))
        counts = np.diff(offsets)[at]
        ids = tokens[spread(offsets[at], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return pa.LargeListArray.from_arrays(pa.array(sums[bounds]), pa.array(ids.astype(np.int32)))

    @staticmethod
    def _bodies(of_token: pa.Array, ids: pa.LargeListArray) -> Iterator[memoryview]:
        """For each row the bytes of its ids in a row."""
        each, rows = of_token.take(ids.values), ids.offsets.to_numpy()
        offsets = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1)[rows].tolist() if len(each) else [0] * len(rows)
        data = memoryview(each.buffers()[2] or b"")
        return (data[first:end] for first, end in zip(offsets, offsets[1:], strict=False))

    def names_digests(self, ids: pa.LargeListArray) -> list[str]:
        """The SHA-256 of each row's decimal ids, joined by one space."""
        return [hashlib.sha256(body[:-1]).hexdigest() for body in self._bodies(self.token_names, ids)]

    def decoded_digests(self, ids: pa.LargeListArray, step: int = 1 << 16) -> list[str]:
        """The SHA-256 of the text that each row's ids decode to, by the incremental decoder, `step` bytes at a time."""
        out = []
        for body in self._bodies(self.token_bytes, ids):
            stream, digest = Utf8Stream(), hashlib.sha256()
            for k in range(0, len(body), step):
                digest.update(stream.feed(bytes(body[k : k + step])).encode("utf-8", "surrogatepass"))
            digest.update(stream.close().encode("utf-8", "surrogatepass"))
            out.append(digest.hexdigest())
        return out


_codecs: dict[tuple[int, str], Codec] = {}


def codec(raw_ranks: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = zlib.crc32(raw_ranks), pattern
    if key not in _codecs:
        _codecs[key] = Codec(raw_ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_tokens, ids (if keep_ids), ids_sha256 and
    decoded_sha256 as the contract of op7 has them. The driver reads the rank file; tasks get its bytes (under 1 MB)."""
    with open(ranks_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw, pattern)
        for batch in sliced(batches, "text", 1_000_000):
            ids = own.encode_column(pick(batch, "text").to_pylist())
            columns = [pick(batch, "doc_id"), pa.array(np.diff(ids.offsets.to_numpy())), pa.array(own.names_digests(ids)), pa.array(own.decoded_digests(ids))]
            yield pa.RecordBatch.from_arrays([*columns, ids.cast(pa.list_(pa.int32()))][: len(names)], names)
        own.transducer.forget()  # the worker may get other work

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
