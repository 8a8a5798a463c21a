"""Encoding equals the tiktoken library's, decoding restores the text."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "abcdefthe ingn\x1c\x1f　\t\n\r  é ß漢字١²Ⅷ🙂😀'sreT01234._-!? "


@pytest.fixture(scope="module")
def both():
    raw = open(PATH, "rb").read()
    return bpe.Codec(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]


def test_column_equals_tiktoken(both):
    codec, other = both
    texts = [*_texts(3000, 1), None, "", "x" * 5000, "the" * 3000, "<|endoftext|>"]
    ids = codec.encode_column(texts)
    want = [other.encode_ordinary(t or "") for t in texts]
    assert ids.to_pylist() == want
    assert codec.names_digests(ids) == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]
    assert codec.decoded_digests(ids) == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


def test_column_goes_through_emissions_of_states(both, monkeypatch):
    """No piece outside the vocabulary is decided elsewhere: all of its ids are outputs of moves or of its last state."""
    _, other = both
    codec = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "merge", lambda *a, of=bpe.merge, **k: of(*a, **k) if "below" in k else pytest.fail("merge decides a piece"))
    t, codec.transducer.FEW = codec.transducer, 1
    assert len(t.states) == 1 and not t.table.held
    words = ["zorblax", "zorblaxing", "quuxification" * 9, "z" * 300]
    assert codec.encode_column([" ".join(words)]).to_pylist() == [other.encode_ordinary(" ".join(words))]
    assert len(t.states) > 20 and t.table.held > 20 and len(t.outputs) > 5
    held = t.table.held
    codec.encode_column(words[:1] * 3)
    more = t.table.held
    assert more - held < 12  # known moves are not made again
    emitted = {x for o in t.outputs for x in o}
    assert set(codec.encode_column([" zorblax" * 50]).to_pylist()[0]) <= emitted | set(t.ranks.values())


def test_lookahead_is_bounded(both):
    """A token is out before more bytes than the longest entry's have followed it."""
    t = bpe.Transducer(bpe.read_ranks(open(PATH, "rb").read()))
    longest = max(map(len, t.ranks))
    state, emitted, read = t.start, 0, 0
    for byte in b"the quick" * 400 + b"z" * 600 + b"ab" * 500:
        number = t._make([state << 8 | byte])[0]
        read += 1
        state = t.to[number]
        emitted += sum(len(t.token_bytes[x]) for x in t.outputs[t.emits[number]])
        assert read - emitted <= 2 * longest


def test_whole_documents_and_a_long_piece(both):
    import pyarrow.parquet as pq

    codec, other = both
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for at in range(0, len(texts), 100):
        assert codec.encode_column(texts[at : at + 100]).to_pylist() == [other.encode_ordinary(t or "") for t in texts[at : at + 100]]
    long = "".join(random.Random(4).choices("abcdefgh", k=1_000_000))
    ids = codec.encode_column([long]).to_pylist()[0]
    assert ids == bpe.merge(codec.transducer.ranks, long.encode()) == codec.encode(long)


def test_streaming_transducer_and_decoder(both):
    codec, other = both
    for t in _texts(500, 2):
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t) and codec.decode(ids) == t
        assert "".join(codec.decode_stream(ids, step=1)) == t


@pytest.mark.parametrize("together,few", [(16384, 6), (16384, 1), (3, 2), (1, 1)])
def test_states_start_afresh(both, together, few):
    _, other = both
    small = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    small.transducer.most, small.transducer.TOGETHER, small.transducer.FEW = 20, together, few
    texts = _texts(200, 3)
    for t in texts:
        assert small.encode(t) == other.encode_ordinary(t)
    assert small.encode_column(texts).to_pylist() == [other.encode_ordinary(t) for t in texts]


def test_vocabulary_not_closed_under_merges(both):
    """Where no sequence of compatible tokens exists, the defining procedure decides."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bcd": 257, b"cd": 258, b"xy": 259}
    t = bpe.Transducer(ranks)
    pieces = [b"abcd", b"xyabcdxy", b"xyxyz", b"abcabc", b"dcdcd"]
    tokens, bounds = t.encode_pieces(pieces)
    for i, p in enumerate(pieces):
        assert tokens[bounds[i] : bounds[i + 1]].tolist() == bpe.merge(ranks, p) == t.encode(p)


def test_merge_equals_plain_procedure():
    ranks = bpe.read_ranks(open(PATH, "rb").read())

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    for text in _texts(300, 8):
        assert bpe.merge(ranks, text.encode()) == plain(text.encode())


def test_utf8_stream_replaces_broken_ends():
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe2\x82") == "a" and s.feed(b"\xacb") == "€b" and s.feed(b"\xf0\x9f") == "" and s.close() == "�"


def test_query(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, "z"), (None, "", "w")], "doc_id long, text string, ids string")
    out = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [0, 2, 2, 0] and out[1].ids == out[2].ids
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
