"""Components against brute force over all pairs, also with tiles so small that every path is taken."""

import random
import re

import pytest

from tidemill.llm.jaccard_join import jaccard_components


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def _rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    base = rng.choices(vocabulary, k=rng.randint(40, 90))
    out = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.3:  # near copies of one text, chained by drift
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = words
        elif kind < 0.5:  # a common passage among other words
            words = rng.choices(vocabulary, k=rng.randint(0, 60)) + passage + rng.choices(vocabulary, k=rng.randint(0, 60))
        elif kind < 0.6 and out:
            words = (out[rng.randrange(len(out))][1] or "").upper().split()
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 6, 8, 9, 30]))
        out.append((d * 3, rng.choice([" ", "\n", "\t "]).join(words)))
    return out


@pytest.mark.parametrize(
    "seed,kw",
    [(1, {}), (2, {"few": 1, "tile_rows": 9}), (3, {"few": 2, "tile_rows": 4096, "tile_shingles": 900}), (4, {"exact": True}), (5, {"exact": True, "few": 1, "tile_rows": 9})],
)
def test_equals_brute_force(spark, seed, kw):
    rows = _rows(seed, 160)
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect())
    assert got == _brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (4, "one two", "e"), (5, "ONE  two", "f"), (None, "one two", "g"), (6, "x " * 3000, "h"), (7, "x " * 2999, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6)]
    assert jaccard_components(docs.limit(0)).count() == 0 and jaccard_components(docs.limit(0), exact=True).count() == 0
    exact = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_components(docs, exact=True).collect())
    assert exact == got


def test_threshold_is_inclusive(spark):
    four, five = "a b c d e f g h", "a b c d e f g h i"  # 4 and 5 shingles, all of the first in the second
    docs = spark.createDataFrame([(1, four), (2, five), (3, "a b c d e f g")], "doc_id long, text string")
    assert [r.component_id for r in jaccard_components(docs).orderBy("doc_id").collect()] == [1, 1, 3]


def test_pipeline_keeps_one_row_per_component(spark):
    from corpus_pipeline import near_duplicates

    long = " ".join(f"w{i}" for i in range(60))
    alone, other, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [
        (1, long), (2, long + " more"), (2, alone), (2, alone.upper()),  # an id of a near copy and of a text of its own
        (3, other), (3, other), (None, other), (None, third), (None, third), (None, third + " more"),
        (4, ""), (4, ""), (5, None), (None, None), (None, " "), (6, third[:40]),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string").repartition(4)
    got = near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = sorted(((r.doc_id or 0), (r.text or "").lower()[:3], len(_set(r.text))) for r in got.collect())
    assert [g for g in got if g[0]] == [(1, "w0 ", 56), (2, "x0 ", 26), (3, "y0 ", 26), (4, "", 0), (5, "", 0), (6, "z0 ", len(_set(third[:40])))]
    nulls = [g[1:] for g in got if not g[0]]
    assert len(nulls) == 3 and nulls[0][1] == 0 and nulls[1][1] == 0 and nulls[2] in {("z0 ", 26), ("z0 ", 27)}


def test_all_links(spark):
    from tidemill.llm.jaccard_join import jaccard_links

    rows = _rows(2, 160)
    pairs, members = jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), few=1, tile_rows=9)
    pairs = [tuple(r) for r in pairs.collect()]
    node = {r.doc_id: r.node for r in members.collect()}
    linked = {(a, b) for p in pairs for a, b in (p, p[::-1])} | {(n, n) for n in node.values() if n is not None}
    sets = {d: _set(t) for d, t in rows}
    want = {(d, e) for d in sets for e in sets if d < e and sets[d] & sets[e] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])}
    got = {(d, e) for d in sets for e in sets if d < e and (node[d], node[e]) in linked}
    assert got == want and len(pairs) == len(set(pairs))


def test_a_lone_hot_key_gives_a_tile(spark):
    from tidemill.llm.jaccard_join import _tiles

    keyed = [(0, node, 50) for node in range(1, 6)] + [(100 * node + k, node, 50) for node in range(1, 6) for k in range(23)]
    tiles = _tiles(spark.createDataFrame(keyed, "key long, node long, n long"), 2, 4096, 4_000_000, 80)
    assert {r.node for r in tiles.collect()} == {1, 2, 3, 4, 5}
