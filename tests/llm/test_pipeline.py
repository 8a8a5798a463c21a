"""The pipeline against a plain program for each stage, each judged on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidemill.llm import bpe, toxicity
from tidemill.llm.pii import BASE_KINDS, find_personal_data

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as rows."""
    now, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, now, SF).write.parquet(path)
        following = spark.read.parquet(path)
        out[name] = now.collect(), following.collect()
        now = following
    return out


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_toxicity_rejects_by_the_model_alone(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    graded = {r.doc_id: r.p_toxic for r in toxicity.grade_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if graded[r.doc_id] < 0.5} and len(after) < len(before)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum(d in kept for d, t in labels.items() if t == 0) > 0.95 * sum(t == 0 for t in labels.values())


def test_near_duplicates_keep_the_first_of_each_group(stages):
    before, after = stages["near_duplicates"]
    sets = {r.doc_id: _shingles(r.text) for r in before}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        common = Counter(e for x in s for e in holders[x] if e < d)
        for e, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after) == sorted(d for d in sets if find(d) == d) and len(after) < len(before)


def test_decontamination_drops_what_holds_an_item(spark, stages):
    from test_decontam import _brute

    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(w[i : i + 5]) for _, t in items for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    # Only texts that share a run of five words with any item can hold one.
    near = [(r.doc_id, r.text) for r in before if any(tuple(w[i : i + 5]) in runs for w in [re.findall(r"\w+", (r.text or "").lower())] for i in range(len(w) - 4))]
    leaks = {d for d, _ in _brute(near, items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - leaks and leaks


def test_personal_data_are_replaced(spark, stages):
    before, after = stages["personal_data"]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    text = {r.doc_id: r.text for r in after}
    changed = 0
    for r in before:
        out, at = [], 0
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += [r.text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        want = "".join(out) + (r.text or "")[at:]
        changed += want != (r.text or "")
        assert (text[r.doc_id] or "") == want
    assert changed and all(r.n_chars == len(r.text or "") for r in after)
    base = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(base.search(t or "") for t in text.values()) and set(BASE_KINDS) == {"email", "ip", "card", "phone"}


def test_encoding_is_that_of_the_library(spark, stages):
    before, after = stages["byte_bpe"]
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in before:
        ids = other.encode_ordinary(r.text or "")
        want[r.doc_id] = (ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (list(r.ids), r.ids_sha256, r.decoded_sha256) for r in after} == want
    run = {r.doc_id: r.ids_sha256 for r in p.run(spark, SF).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in after}


def test_odd_rows(spark):
    """Null ids, repeated rows, nulls, empty and very long texts, extra columns that clash with the stages' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, long), (1, long), (2, None), (2, None), (3, ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, "mail me at x.y@example.org today please"), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", None, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node long")
    docs = docs.withColumns({"_row": F.lit(1), "mark": F.lit("m"), "tile": F.lit(2), "keys": F.lit(None).cast("string")}).repartition(3)
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    got = now.collect()
    assert Counter((r.doc_id, (r.text or "")[:7]) for r in got if r.text) == Counter({(1, "w0 w1 w"): 1, (None, "a b c d"): 1, (4, "mail me"): 1})
    assert sum(r.doc_id == 2 for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 1
    assert "[EMAIL]" in next(r.text for r in got if r.doc_id == 4) and {(r["_row"], r.mark, r.node) for r in got} == {(1, "m", 7)}
    assert p.STAGES[-1][1](spark, now, SF).count() == len(got)
