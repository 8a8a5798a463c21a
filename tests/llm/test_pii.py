"""Spans against Python's regular expressions; validators; redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm.pii import digest, find_personal_data, luhn, mod97, redacted, running_sums

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(d):
    return sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out, counts = [], []
    for kind, p in PATTERNS.items():
        before = len(out)
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and _passes(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(out) - before)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest())


def _texts():
    rng = random.Random(6)
    bits = ["a@b.cc", "x_y@d-e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+", "-", " ", "  ", "é", "😀", "12", "0", "\n", "card ", "_", "%"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(600)]


def test_base_spans(spark):
    texts = [*_texts(), None, "", "x" * 30000 + "@y.zz " + "1" * 30000 + " u@v.w" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in digest(find_personal_data(docs)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _base(t), (i, t)
    assert digest(find_personal_data(docs.limit(0))).count() == 0


def test_further_kinds_need_validation(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "DE89370400440532013000", "DE89370400440532013001", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in digest(find_personal_data(docs)).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "iban:0:22", "", "secret:9:49", ""]


def test_redaction(spark):
    texts = ["mail a@b.cc or +1 (555) 123-4567.", None, "nothing", "é 1.2.3.4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", redacted(F.coalesce("text", F.lit(""))).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["mail [EMAIL] or [PHONE].", "", "nothing", "é [IP]"]


def test_validators(spark):
    r = spark.range(1).select(luhn(F.lit("4111111111111111")).alias("a"), luhn(F.lit("4111111111111112")).alias("b"), mod97(F.lit("GB82 WEST 1234 5698 7654 32")).alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, 1)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    values = [i % 7 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v")).alias("s"))
    assert df.first().s == [sum(values[: i + 1]) for i in range(n)]
