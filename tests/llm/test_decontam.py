"""Leaks against a brute-force search of all windows."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidemill.llm.decontam import ItemIndex, drop_leaking, find_leaks, near_bytes

VOCABULARY = [f"word{i}" for i in range(300)]


def _words(t):
    return re.findall(r"\w+", (t or "").lower())


def _brute(docs, items, least=0.8):
    held = Counter()
    for _, t in items:
        w = _words(t)
        held.update({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    weigh = lambda s: math.log(1 + len(items) / held[s]) if s in held else math.log(1 + len(items))

    def bag(w):
        out = Counter()
        for i in range(len(w) - 4):
            s = tuple(w[i : i + 5])
            out[s] += weigh(s)
        return out

    found = {}
    for d, t in docs:
        w = _words(t)
        for item, it in items:
            v = _words(it)
            for i in range(len(w) - len(v) + 1 if v else 0):
                if len(v) < 5:
                    best = float(w[i : i + len(v)] == v)
                else:
                    a, b = bag(w[i : i + len(v)]), bag(v)
                    common = sum(min(a[s], b[s]) for s in a)
                    best = common / (sum(a.values()) + sum(b.values()) - common)
                if best >= least:
                    found[d, item] = max(found.get((d, item), 0), round(best, 9))
    return found


def test_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=n))) for k, n in enumerate([3, 4, 5, 14, 30, 59, 59, 0])] + [(8, None)]
    docs = []
    for d in range(120):
        w = rng.choices(VOCABULARY, k=rng.randint(0, 120))
        if d % 3 == 0:
            part = _words(items[rng.randrange(len(items))][1])
            if d % 2 and len(part) > 8:
                part[-1 if d % 4 == 1 else len(part) // 2] = "changed"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, [" ", "\n", ", "][d % 3].join(x.upper() if d % 5 == 0 else x for x in w)))
    docs += [(200, None), (201, "")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (8_000_000, 300):
        if blocks == 300:  # weights are by block, so only the pairs are compared
            got = {(r.doc_id, r.item_id) for r in find_leaks(left, right, block_bytes=blocks).collect()}
            assert got >= {k for k, v in _brute(docs, items).items() if v == 1}
        else:
            got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(left, right).collect()}
            assert got == _brute(docs, items)
    kept = {r.doc_id for r in drop_leaking(left, right).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in _brute(docs, items)}


def test_index_finds_all_within_radius():
    rng = random.Random(5)
    near = near_bytes(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 23):
            b ^= 1 << bit
        assert any((b >> 8 * k & 255) in near[a >> 8 * k & 255] for k in range(8))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0 and drop_leaking(docs, none).count() == 1
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_blocks_change_nothing(spark):
    """Items share parts across blocks, so that weights of one block would differ from those of the whole benchmark."""
    rng = random.Random(6)
    shared = [rng.choices(VOCABULARY, k=30) for _ in range(3)]
    part = lambda: rng.choices(VOCABULARY, k=rng.randint(1, 8))
    items = [(k, " ".join(shared[k % 3] + part())) for k in range(30)] + [(k, " ".join(rng.choices(VOCABULARY, k=k - 25))) for k in range(30, 40)]
    docs = [(d, " ".join(part() + shared[d % 3] + part())) for d in range(90)]
    docs += [(d, items[d - 90][1] + " " + " ".join(part())) for d in range(90, 120)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    whole = {(r.doc_id, r.item_id): tuple(r) for r in find_leaks(left, right).collect()}
    assert {k: round(r[2], 9) for k, r in whole.items()} == want
    rows = find_leaks(left, right, block_bytes=2500).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.item_id): tuple(r) for r in rows} == whole
    kept = {r.doc_id for r in drop_leaking(left, right, block_bytes=5000).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_of_repeated_ids_and_short_items(spark):
    items = [(k // 2, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20)] + [(-1, "x y z"), (30, "u v")]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items))], "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(find_leaks(docs, right, block_bytes=700).collect()) == sorted(find_leaks(docs, right).collect())
    short = right.where("item_id in (-1, 30)")
    assert find_leaks(docs, short, block_bytes=60).count() == 2


def test_odd_rows(spark):
    """Repeated rows, clashing columns, null ids, a very long text and empty ones."""
    item = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i}" for i in range(100_000)) + " " + item + " " + " ".join(f"v{i}" for i in range(100_000))
    rows = [(1, item), (1, item), (2, long), (None, item.upper()), (3, None), (4, " . ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as item_id", "0.5 as similarity", "'x' as first_word", "1 as n_words")
    items = spark.createDataFrame([(5, item), (5, item), (6, None), (None, "")], "item_id long, text string").selectExpr("*", "9 as doc_id", "1 as k")
    for blocks in (8_000_000, 60):
        got = sorted(((r.doc_id or 0), r.item_id, r.similarity, r.first_word, r.n_words) for r in find_leaks(docs, items, block_bytes=blocks).collect())
        assert got == [(0, 5, 1.0, 0, 10), (1, 5, 1.0, 0, 10), (1, 5, 1.0, 0, 10), (2, 5, 1.0, 100_000, 10)]
        kept = drop_leaking(docs, items, block_bytes=blocks)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=n))) for k, n in enumerate([6, 20, 40, 40])]
    docs = []
    for k, t in items:
        w = t.split()
        docs += [(10 * k + j, " ".join(x)) for j, x in enumerate([w[:-1], w[1:], w[1:-1], w[: len(w) // 2], w[:4]])]
    padded = lambda t, n: t + " ." * n
    want = {}
    for d, t in docs:
        for item, it in items:
            # The document is shorter than the item it is cut from, so it is one window.
            held = Counter(s for _, x in items for s in {tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)})
            bags = [Counter(tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)) for x in (t, it)]
            weigh = lambda s: math.log(1 + len(items) / held.get(s, 1))  # noqa: E731, B023
            common, either = (sum(weigh(s) * n for s, n in x.items()) for x in (bags[0] & bags[1], bags[0] | bags[1]))
            if common >= 0.8 * either:
                want[d, item] = round(common / either, 9), len(t.split())
    assert len(want) >= 6
    left = spark.createDataFrame([(d, padded(t, d % 3)) for d, t in docs], "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.n_words) for r in find_leaks(left, right).collect()} == want
    assert {r.doc_id for r in drop_leaking(left, right).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def _weighted(items, text):
    """Similarity of a text of as many words as the items to each of them, by the definition."""
    bags = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (x.split() for x in [*items, text])]
    held = Counter(s for b in bags[:-1] for s in b)
    weigh = {s: math.log(1 + len(items) / held.get(s, 1)) for b in bags for s in b}
    own = bags[-1]
    out = []
    for b in bags[:-1]:
        common = sum(min(c, own[s]) * weigh[s] for s, c in b.items())
        total = sum(c * weigh[s] for x in (b, own) for s, c in x.items())
        out.append(common / (total - common))
    return out


@pytest.mark.parametrize("length,tail", [(92, 1), (96, 1), (100, 1), (60, 0), (200, 3)])
def test_items_that_share_a_template_are_all_found(spark, length, tail):
    """Heavy shingles of their own beside a light template: fingerprints differ in many bits at similarities of 0.8 and more."""
    rng = random.Random(length)
    template = [f"w{rng.randrange(5000)}" for _ in range(length)]
    items = [" ".join([*template, *[f"own{i}x{k}" for k in range(tail)]]) for i in range(300)]
    text = " ".join([*template, *[f"other{k}" for k in range(tail)]])
    want = {i for i, s in enumerate(_weighted(items, text)) if s >= 0.8}
    assert len(want) in (0, 300)
    found = find_leaks(spark.createDataFrame([(1, "before it " + text + " and after")], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.item_id for r in found.collect()} == want


def test_index_alone_finds_nearly_all():
    """The radius, without what is verified beyond it: items with a rare word of their own, and with repeated runs."""
    rng = random.Random(7)
    hit = total = 0
    for _ in range(6):
        template = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(92, 100))]
        items = [" ".join([*template, f"own{i}"]) for i in range(100)]
        index = ItemIndex.build(list(enumerate(items)), 5, 0.8, 23)
        index.beyond = False
        text = " ".join([*template, "other"])
        want = {i for i, s in enumerate(_weighted(items, text)) if s >= 0.8}
        hit, total = hit + len(want & index.search(pa.array([text]))[0].keys()), total + len(want)
    assert total and hit >= 0.99 * total
