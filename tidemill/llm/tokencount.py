"""Token counts under a unigram vocabulary, by dynamic programming that pre-tokens share through a trie.

A text's pre-tokens are its words with a word mark before each. The distinct ones of a slice of the input are inserted into
a trie, a level at a time. The forward score of a node - the best sum of piece scores that spells the prefix it stands for -
depends on nothing below it, so it is computed once for all pre-tokens that share the prefix, together with the number of
pieces on the best path; the node at which a pre-token ends is its terminal and has its count. Pieces are matched through a
trie of the vocabulary: a node carries the vocabulary nodes of all its suffixes that begin a piece. Code points that no piece
covers cost one token for each UTF-8 byte. Of equal scores the path with fewer tokens counts.

Memory: the trie of a slice, in proportion to its bytes. Where fewer than `few` pre-tokens are as long as that, nothing is
shared and each is finished by itself, with the same recurrence. Nulls and empty texts have no tokens; texts and pre-tokens
may be of any length; rows are independent, so repeated rows count alike and an empty table gives none; other columns, whatever
their names, are ignored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import pick, sliced
from tidemill.llm._table import Table

MARK = "▁"
#: Unicode white space, which ends words.
_SPLIT = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def read_pieces(model_path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model: log-probabilities if it is a unigram model; a model of merges has ranks
    instead, and a piece of rank r gets the log-probability of Zipf's law, -log((r + 1) * H)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in ids])
    if (scores == np.round(scores)).all():
        rank = np.empty(len(ids))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(ids))
        scores = -np.log((rank + 1) * (np.log(len(ids)) + 0.5772))
    return {model.id_to_piece(i): float(s) for i, s in zip(ids, scores, strict=True)}


class Counter:
    """Counts tokens of pre-tokens."""

    def __init__(self, pieces: dict[str, float], few: int = 6):
        self.pieces, self.few = pieces, few
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=0)
        child: dict[int, int] = {}
        #: By node of the vocabulary's trie: the score of the piece that ends there, NaN for none.
        ends = [np.nan]
        #: By last character: the lengths that pieces have, shortest first.
        lengths: dict[str, set[int]] = {}
        for piece, score in pieces.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(ends)
                    ends.append(np.nan)
                node = child[key]
            ends[node] = score
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        self.ends, self.children = np.array(ends), Table(17)
        self.children.put(np.array(list(child), np.int64), np.array(list(child.values()), np.int32))

    def count(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of distinct pre-tokens."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order], np.int64)
        codes = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        trie = _Trie(self, len(codes) + 1)
        node = np.zeros(len(words), np.int64)
        depth = 0
        while len(words) and depth < sizes[0]:
            m = int(np.searchsorted(-sizes, -depth, "left"))  # words longer than depth come first
            if m < self.few:
                break
            node[:m] = trie.grow(node[:m], codes[starts[:m] + depth])
            depth += 1
        found = list(zip(trie.tokens[node].tolist(), trie.scores[node].tolist(), strict=True))
        for i in range(int(np.searchsorted(-sizes, -depth, "left"))):
            found[i] = self._finish(words[order[i]], depth, trie.path(int(node[i]), self.longest))
        out: list[tuple[int, float]] = [(0, 0.0)] * len(words)
        for i, x in zip(order, found, strict=True):
            out[i] = x
        return out

    def _finish(self, word: str, depth: int, path: list[tuple[float, int]]) -> tuple[int, float]:
        """(tokens, score) of a word of which the first `depth` characters are done; path: the last ones' scores and tokens."""
        get, kept = self.pieces.get, max(self.longest, 1)
        for i in range(depth + 1, len(word) + 1):
            c = word[i - 1]
            size = len(c.encode("utf-8", "surrogatepass"))
            best, n = path[-1][0] + self.byte * size, path[-1][1] + size
            for length in self.lengths.get(c, ()):
                if length > i:
                    break
                score = get(word[i - length : i])
                if score is not None:
                    before = path[-length]
                    total = before[0] + score
                    if total > best or total == best and before[1] + 1 < n:
                        best, n = total, before[1] + 1
            path.append((best, n))
            if len(path) > 4096 + kept:
                del path[:-kept]
        return path[-1][1], path[-1][0]


class _Trie:
    """Pre-tokens' trie: parents, forward scores and numbers of tokens by node, the root being 0. `grow` adds a level."""

    def __init__(self, counter: Counter, most: int):
        self.counter, self.size = counter, 1
        self.parent, self.tokens, self.scores = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most)
        # Matches under way at the last level's nodes, in order of node: where the piece begins, and its vocabulary node.
        self.first, self.open = 0, np.zeros(1, np.int64)
        self.begun, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def grow(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of nodes of the last level by a code point each; makes those and scores them."""
        counter = self.counter
        keys, which = np.unique(node << 21 | code, return_inverse=True)
        parent, code = keys >> 21, keys & 0x1FFFFF
        made = np.arange(self.size, self.size + len(keys))
        # A child goes on with its parent's matches, and one may begin here.
        many = self.open[parent - self.first] + 1
        before = np.cumsum(self.open) - self.open
        own = np.repeat(np.arange(len(keys)), many)
        place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        goes_on = place < many[own] - 1
        source = before[parent - self.first][own[goes_on]] + place[goes_on]
        begun, at = parent[own], np.zeros(len(own), np.int64)
        begun[goes_on], at[goes_on] = self.begun[source], self.at[source]
        at = counter.children.get(at << 21 | code[own]).astype(np.int64)
        live = at >= 0
        own, begun, at = own[live], begun[live], at[live]
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        best, tokens = self.scores[parent] + counter.byte * size, self.tokens[parent] + size
        ends = counter.ends[at]
        done = ~np.isnan(ends)
        if done.any():
            of, total, count = own[done], self.scores[begun[done]] + ends[done], self.tokens[begun[done]] + 1
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            top = np.maximum.reduceat(total, cuts)
            fewest = np.minimum.reduceat(np.where(total == np.repeat(top, np.diff(np.append(cuts, len(of)))), count, 1 << 60), cuts)
            of = of[cuts]
            better = (top > best[of]) | (top == best[of]) & (fewest < tokens[of])
            best[of[better]], tokens[of[better]] = top[better], fewest[better]
        self.parent[made], self.scores[made], self.tokens[made] = parent, best, tokens
        self.first, self.open = self.size, np.bincount(own, minlength=len(keys))
        self.begun, self.at = begun, at
        self.size += len(keys)
        return made[which]

    def path(self, node: int, most: int) -> list[tuple[float, int]]:
        """Scores and tokens of a node and of up to `most` above it, from the top."""
        out = [(float(self.scores[node]), int(self.tokens[node]))]
        while node and len(out) <= most:
            node = int(self.parent[node])
            out.append((float(self.scores[node]), int(self.tokens[node])))
        return out[::-1]


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_pretokens, n_tokens, score (the best paths' log-probability, 6 places).
    The driver reads the model; tasks get its pieces (32,000 of them, about 1 MB)."""
    pieces = read_pieces(model_path)
    key = hash(tuple(sorted(pieces.items())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters[key] = Counter(pieces)
        counter = _counters[key]
        for batch in sliced(batches, "text", 4_000_000):
            text = pc.fill_null(pick(batch, "text").cast(pa.large_string()), "")
            lists = pc.split_pattern_regex(text, _SPLIT)
            flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = flat.dictionary_encode()
            words = coded.dictionary.to_pylist()
            found = counter.count([MARK + w for w in words])
            real = np.array([bool(w) for w in words])
            tokens = np.where(real, [n for n, _ in found], 0).astype(np.int64)
            scores = np.where(real, [s for _, s in found], 0.0)
            at = coded.indices.to_numpy()

            def per_row(values: np.ndarray, at=at, bounds=bounds) -> np.ndarray:
                sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[at])])
                return sums[bounds[1:]] - sums[bounds[:-1]]

            each = [float(scores[at[a:b]].sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "doc_id"), pa.array(per_row(real.astype(np.int64))), pa.array(per_row(tokens)), pa.array(np.round(each, 6) + 0.0, pa.float64())],
                ["doc_id", "n_pretokens", "n_tokens", "score"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
