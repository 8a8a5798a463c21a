"""Chat formatting, token counts, extraction, fingerprints, classifiers and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm import chat, html_extract, merkle, ordinal, quality, tokencount, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment", [3, 128])
def test_chat_round_trip(spark, segment):
    rng = random.Random(2)
    bits = ["\\", "<turn ", "</turn>", "<part>", ">", "\n", "a", "</tu", "<", "é"]
    rows = [(c, rng.choice([None, 0, 1, 2, 9]), rng.choice(["user", "assistant", "a>b", None, "as\\s"]), rng.choice([None, ""] + ["".join(rng.choices(bits, k=k)) for k in range(1, 8)])) for c in (1, 2, None) for _ in range(150)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as segment", "1 as piece", "2 as blocks", "3 as at")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, segment=segment, partitions=5)).collect()}
    for c in (1, 2, None):
        own = sorted([(x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == c], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        said = "".join(t for _, r, t in own if r == "assistant")
        assert out[c].n_turns == len(own) and out[c].loss_chars == len(said)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_of_long_texts_and_a_hot_conversation(spark):
    rows = [(1, t, "user" if t % 700 else "assistant", "word " * (t % 5)) for t in range(3000)] + [(c, 0, "user", "x") for c in range(2, 200)]
    rows += [(500, 0, "assistant", "<turn " * 200_000 + "é"), (500, 1, "assistant", "\\" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, partitions=6)).collect()}
    assert out[1].n_turns == 3000 and out[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert out[500].loss_sha256 == hashlib.sha256((rows[-2][3] + rows[-1][3]).encode()).hexdigest() and out[500].loss_chars == 1_500_001
    segments = chat.format_conversations(turns, partitions=6).where("conv_id = 1").orderBy("segment").collect()
    assert [s.segment for s in segments] == list(range(len(segments))) and len(segments) >= 24 and "".join(s.formatted for s in segments).count("<turn ") == 10


def test_chat_merges_turns_of_one_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), partitions=1).first()
    assert f.formatted == "<turn user>\na<part>b</turn>\n<turn assistant>\nc</turn>\n"
    assert [f.formatted[s.start : s.end] for s in f.loss_spans] == ["c"]


def test_token_counts_equal_plain_programming():
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counter = tokencount.Counter(pieces)
    rng = random.Random(3)
    words = list({"▁" + "".join(rng.choices("etaoinsé漢😀th", k=rng.randint(0, 12))) for _ in range(400)}) + ["▁" + "the" * 40 + "x" * k for k in range(9)]

    def plain(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            b = len(w[i - 1].encode())
            options = [(best[i - 1][0] + counter.byte * b, best[i - 1][1] - b)]
            options += [(best[j][0] + pieces[w[j:i]], best[j][1] - 1) for j in range(i) if w[j:i] in pieces]
            best.append(max(options))
        return -best[-1][1], best[-1][0]

    want = [plain(w) for w in words]
    for few in (1, 6, 1000):
        counter.few = few
        assert counter.count(words) == want and counter.count(words[:3]) == want[:3] and counter.count([]) == []
    trie = tokencount._Trie(counter, 100)
    node = np.zeros(3, np.int64)
    for codes in zip(*[map(ord, w) for w in ("then", "them", "thus")], strict=True):
        node = trie.grow(node, np.array(codes))
    assert trie.size == 1 + 2 + 2 + 3 and len(set(node.tolist())) == 3  # t, th; the, thu; then, them, thus


def test_token_counts_of_whole_rows(spark):
    """Every row of sf0.01 by a plain program: words by Unicode white space, and the plain recurrence for each."""
    from functools import cache

    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    byte, longest = min(pieces.values()) - 10.0, max(map(len, pieces))

    @cache
    def plain(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            b = len(w[i - 1].encode())
            options = [(best[i - 1][0] + byte * b, best[i - 1][1] - b)]
            options += [(best[j][0] + pieces[w[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if w[j:i] in pieces]
            best.append(max(options))
        return -best[-1][1], best[-1][0]

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000 or text is null")
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    rows = docs.collect()
    assert len(rows) == len(got) > 500
    for r in rows:
        words = [plain("▁" + w) for w in (r.text or "").replace("\x1c", "\0").replace("\x1d", "\0").replace("\x1e", "\0").replace("\x1f", "\0").split()]
        own = got[r.doc_id]
        assert (own.n_pretokens, own.n_tokens) == (len(words), sum(n for n, _ in words)) and own.score == pytest.approx(sum(s for _, s in words), abs=1e-5)


def test_token_counts_of_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "the the", 0), (4, "the the", 0), (5, "z" * 20000, 0)], "doc_id long, text string, score int")
    out = [(r.doc_id, r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(docs, path).orderBy("doc_id").collect()]
    assert out[:5] == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 2), (4, 2, 2)] and out[5][2] > 1000
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy</div><div class="cookie-notice">cookies</div><article class="post-12"><h1>Head &amp; tail</h1><p>One  two<b>three</b>
four<p>&lt;five&gt; &#233;<script>if (a < b) "</p>"</script><aside>side</aside><form><input>f</form><p>six<!-- x --></article>
<div id="comments"><p>comment text</p></div><footer>&copy;</footer></body></html>"""


def test_extraction():
    path, _ = html_extract.best_path(PAGE)
    assert path == "/html/body/article.post"
    want = "Head & tail\nOne twothree four\n<five> é\nsix"
    assert html_extract.extract(PAGE, path) == want and html_extract.extract(PAGE, None) == want
    for odd in (None, "", "<", "<p", "a<", "<!-- x", "<script>x", "</p></p>", "<p>" * 3000, "<a href='x>y"):
        html_extract.extract(odd, None)
    assert html_extract.extract("<body><p>a &am", None) == "a &am"
    assert html_extract.extract(None, path) == "" and html_extract.extract("<nav>menu</nav>", path) == ""


def test_extraction_by_host(spark):
    other = "<html><body><div class='main-1'><p>" + "long text " * 30 + "</p></div><div class='foot'><p>x</p></div></body></html>"
    short = "<html><body><div class='main-2'><p>hi</p></div><div class='foot'><p>a longer foot line</p></div></body></html>"
    rows = [(k, "http://a.example/x", other) for k in range(5)] + [(9, "http://a.example/y?z", short), (10, None, None), (11, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_extract.F.lit(1))
    out = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    assert out[9].text == "hi" and out[9].n_chars == 2 and out[10].text == "" and out[11].text == "" and len(out) == 8
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_fingerprints_of_edits(spark):
    rng = random.Random(5)
    rows = [(d * 2, " ".join(rng.choices(["ab", "cde", "f", "é", "\n", "ghi"], k=rng.randint(0, 80)))) for d in range(60)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", merkle.F.lit("x")).repartition(5)
    for each in (7, 1000):
        out = {r.doc_id: r for r in merkle.fingerprint_edits(docs, rows_each=each).collect()}
        own = sorted((d, t or "") for d, t in rows)
        for (d, t), (_, u) in zip(own, own[1:] + own[:1], strict=True):
            cut = len(t) // 4
            e = t[: len(t) - cut] + u[:cut]
            r = out[d]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert [r.fingerprint, r.edited_fingerprint] == merkle.fingerprints([t, e])
            assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
    assert merkle.fingerprint_edits(docs.limit(0)).count() == 0
    one = merkle.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1


def _paragraph(fingerprint, place):
    """The number of a paragraph, counted over all sections."""
    return sum(s.count(",") + 1 for s in fingerprint.split("/")[1 : place[0] + 1]) + place[1]


def test_differences_locate_edits():
    lines = [f"line {i} of some words here {i * i}" for i in range(60)]
    text = "\n".join(lines)
    a, b = merkle.fingerprints([text, text.replace("line 20 ", "line XX ")])
    found = merkle.differences(a, b)
    assert [_paragraph(a, p) for p in found] == [20] and merkle.differences(a, a) == [] and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.located(a, b) == f"{found[0][0]}.{found[0][1]}" and merkle.located(a, a) == ""
    rng = random.Random(9)
    for _ in range(60):
        new, touched = list(lines), set()
        for i in sorted(rng.sample(range(60), rng.randint(0, 4)), reverse=True):
            touched.add(i)
            new[i : i + 1] = rng.choice([[], [f"other {i} words are here"], [f"other {i} words", f"and more of {i} them"]])
        at = rng.randint(0, len(new))
        new[at:at] = [f"new line {k} with words {k * 7}" for k in range(rng.choice([0, 0, 1, 20]))]  # moves all that follows
        b = merkle.fingerprints(["\n".join(new)])[0]
        assert {_paragraph(a, p) for p in merkle.differences(a, b)} == touched
    a, b = merkle.fingerprints(["\n".join(["same words again"] * 50), "\n".join(["same words again"] * 48)])
    assert len(merkle.differences(a, b)) == 2


def _tree(text):
    """A plain reading of the fingerprint: (paragraphs as lists of pieces of words)."""
    from tidemill.llm._text import NOT_BLANK, words
    import pyarrow as pa
    import re

    out = []
    for line in text.split("\n"):
        found = re.findall(r"[^\x20\x09-\x0D]+", line)
        if found:
            hashes = [int(words(pa.array([w]), NOT_BLANK, fold=False)[0][0]) for w in found]
            pieces, now = [], []
            for w, h in zip(found, hashes, strict=True):
                now.append(w)
                if h % 4 == 0:
                    pieces.append(now)
                    now = []
            pieces += [now] if now else []
            out.append([tuple(p[i : i + merkle.LONGEST]) for p in pieces for i in range(0, len(p), merkle.LONGEST)])
    return out


def test_fingerprints_against_a_plain_tree():
    """Leaves stand for pieces one to one, paragraphs stand where the plain reading has them, likeness counts common pieces."""
    from collections import Counter

    rng = random.Random(6)
    texts = [" ".join(rng.choices(["ab", "cde", "f", "é", "\n", "ghi", "\t x", "Ab"], k=rng.randint(0, 90))) for _ in range(120)] + ["", "one", "\n\n"]
    prints, trees = merkle.fingerprints(texts), [_tree(t) for t in texts]
    name = {}
    for p, tree in zip(prints, trees, strict=True):
        bodies = [x for s in p.split("/")[1:] for x in s.split(",")]
        assert [len(b) // merkle.WIDTH for b in bodies] == [len(x) for x in tree]
        for body, pieces in zip(bodies, tree, strict=True):
            for i, piece in enumerate(pieces):
                leaf = body[merkle.WIDTH * i : merkle.WIDTH * (i + 1)]
                assert name.setdefault(piece, leaf) == leaf
    assert len(set(name.values())) == len(name)
    for i in range(0, 120, 7):
        for j in range(0, 120, 11):
            x, y = (Counter(p for line in trees[k] for p in line) for k in (i, j))
            either = x.total() + y.total()
            want = 1.0 if texts[i] == texts[j] else 2 * (x & y).total() / either if x and y else 0.0
            assert merkle.likeness(prints[i], prints[j]) == pytest.approx(want)
        assert (prints[i] == prints[i + 1]) == (texts[i] == texts[i + 1])


def test_fingerprints_of_odd_tables(spark):
    rows = [(5, "b a"), (5, "a b"), (5, "a b"), (None, "x y"), (None, None), (7, "long words " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as own", "'k' as key").repartition(3)
    for kw in ({}, {"rows_each": 1}, {"rows_each": 1, "most_parts": 2}):
        out = merkle.fingerprint_edits(docs, **kw).collect()
        order = sorted(((d is not None, d or 0, t or "") for d, t in rows))
        want = sorted(hashlib.sha256(merkle.edited(a[2], b[2]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True))
        assert sorted(r.edited_sha256 for r in out) == want and sorted(r.n_chars for r in out) == [0, 3, 3, 3, 3, 1_100_000]
        assert all(r.near_next == 1 for r in out if r.doc_id == 5 and r.near_next > 0.99) and max(r.near_next for r in out) == 1


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    z = rng.normal(size=3000)
    grades = np.digitize(z + rng.logistic(size=3000) * 0.3, [-0.5, 0.8])
    weights, cuts = ordinal.fit_cumulative_link([(np.array([0]), np.array([v])) for v in z], grades, 1, 3, ridge=0.01, rounds=800)
    assert weights[0] > 2 and cuts[0] < cuts[1] and cuts[0] / weights[0] == pytest.approx(-0.5, abs=0.15) and cuts[1] / weights[0] == pytest.approx(0.8, abs=0.15)


def _held_out(spark, sf, grade, column, flag):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("pmod(xxhash64(doc_id), 5) > 0")
    out = {r.doc_id: r[flag] for r in grade(docs, train).collect()}
    test = labels.where("pmod(xxhash64(doc_id), 5) = 0").collect()
    return np.array([(r[column], out[r.doc_id]) for r in test])


def test_held_out_accuracy(spark):
    toxic = _held_out(spark, "/root/testdata/sf0.1", toxicity.grade_toxicity, "toxic", "rejected")
    assert (toxic[toxic[:, 0] == 1, 1]).mean() > 0.8 and (toxic[toxic[:, 0] == 0, 1]).mean() < 0.02
    good = _held_out(spark, "/root/testdata/sf0.1", quality.grade_quality, "quality", "selected")
    assert (good[:, 0] == good[:, 1]).mean() > 0.9


def test_second_thresholds_on_held_out_rows(spark):
    """Both thresholds cut where they should on rows that the models haven't seen: grade 2 of quality is good and not toxic."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("pmod(xxhash64(doc_id), 5) > 0"), labels.where("pmod(xxhash64(doc_id), 5) = 0").collect()
    out = {r.doc_id: r for r in quality.grade_quality(docs, train).collect()}
    best = np.array([(r.quality == 1 and r.toxic == 0, out[r.doc_id].p_best >= 0.5) for r in test if r.quality is not None and r.toxic is not None])
    assert (best[:, 0] == best[:, 1]).mean() > 0.85
    severity = {r.doc_id: r for r in toxicity.grade_toxicity(docs, train).collect()}
    assert all(0 <= r.p_severe <= r.p_toxic <= 1 and abs(r.expected_severity - r.p_toxic - r.p_severe) < 1e-9 for r in severity.values())
    toxic = [severity[r.doc_id] for r in test if r.toxic == 1]
    clean = [severity[r.doc_id] for r in test if r.toxic == 0]
    assert np.mean([r.p_severe >= 0.5 for r in clean]) < 0.01 < 0.2 < np.mean([r.p_severe >= 0.5 for r in toxic]) < 0.8


def test_sample_takes_one_row_of_a_repeated_doc_id(spark):
    rows = [(1, f"text number {i % 3} of many") for i in range(20_000)] + [(2, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = ordinal.sampled(docs, labels, ["toxic"], 10, shape=False)
    assert [r["doc_id"] for r in got] == [1, 2] and [len(r["features"]) for r in got] == [len(r["features"]) for r in ordinal.sampled(docs.orderBy("text"), labels, ["toxic"], 10, shape=False)]


def test_classifiers_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "word " * 5000, 0.0), (None, "x", 0.0)], "doc_id long, text string, grade double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.rejected for r in toxicity.grade_toxicity(docs, none).collect()] == [False] * 4
    some = spark.createDataFrame([(1, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.grade_quality(docs.limit(0), some).count() == 0 and toxicity.drop_toxic(docs.limit(0), docs, some).count() == 0
    assert quality.grade_quality(docs, none).count() == 4 and toxicity.grade_toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0, None), (3, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.grade_toxicity(docs, one).count() == 4 and toxicity.drop_toxic(docs, docs, one).columns == docs.columns


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0.6 * sizes[0]
    out = p.byte_bpe(spark, now, SF)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {r.doc_id: r.n_tokens for r in p.run(spark, SF).collect()}
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
