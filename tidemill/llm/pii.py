"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Only DataFrame functions are used. Base kinds: email, ip (parts up to 255), card (13 to 19 digits that pass Luhn) and phone
(9 to 15 digits), each with the leftmost non-overlapping matches of its pattern; matches that fail are dropped. Further
kinds: iban (mod-97) and secret (a long token of letters and digits), which need a score of `least`; base spans stay
whatever their score. A score is the kind's own, plus 0.2 if one of the kind's context words stands within the 40 code
points before the span. Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are independent,
so ties and repeated rows are treated alike, and an empty table gives no rows; other columns are passed by.

Patterns are written so that long runs of one class of characters take linear time; each finds just the matches that the
plain form has: email and ip begin where a run or the last match does, and card takes whole chains of digits only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")

# Patterns, scores and context words by kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|from",
    "card": "card|visa|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "secret": "token|key|secret|password|passwd|credential",
}

_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(lengths: Column, first: Column, count: Column) -> Column:
    return F.aggregate(F.slice(lengths, first, count), F.lit(0), lambda a, x: a + x)


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Sums of all elements up to and including each one; by blocks, so that long arrays don't take quadratic time."""

    def by_block(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: _total(x, b * block + 1, F.lit(block)))
        before = let(sums, lambda s: F.transform(s, lambda _, b: _total(s, F.lit(1), b)))
        return let(
            before,
            lambda s: F.transform(
                x, lambda _, i: F.get(s, F.floor(i / block).cast("int")) + _total(x, F.floor(i / block).cast("int") * block + 1, i % block + 1)
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, by_block)).otherwise(F.expr("cast(array() as array<int>)"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def weighted(c: Column, i: Column, n: Column) -> Column:
        doubled = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    def passes(d: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: weighted(F.substring(d, i, F.lit(1)), i - 1, F.length(d)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    return F.when(F.length(digits) > 0, let(digits, passes)).otherwise(F.lit(False))


def mod97(account: Column) -> Column:
    """The remainder that an IBAN's checksum takes: the first four characters go last, letters count from 10."""
    moved = let(F.regexp_replace(account, " ", ""), lambda a: F.concat(F.substring(a, 5, 64), F.substring(a, 1, 4)))

    def step(left: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (left * F.when(value > 9, 100).otherwise(10) + value) % 97

    def remainder(a: Column) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1))), F.lit(0), step)

    return let(moved, remainder)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)) <= "255"
        )
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match) == 1
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def kind_spans(text: Column, kind: str, least: float) -> Column:
    """The spans of one kind, in order."""
    pattern = PATTERNS[kind]
    none = F.expr(f"cast(array() as {_SPANS})")

    def located(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        lengths = F.transform(F.arrays_zip(between.alias("gap"), matches.alias("hit")), lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))

        def cut(pair: Column) -> Column:
            hit, end = pair["hit"], pair["end"]
            start = end - F.length(hit)
            before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
            near = F.when(before.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.2).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (F.lit(SCORES[kind]) + near).alias("score"))

        pairs = F.arrays_zip(matches.alias("hit"), F.slice(running_sums(lengths), F.lit(1), F.size(matches)).alias("end"))
        kept = F.transform(F.filter(pairs, lambda p: _valid(kind, p["hit"])), cut)
        return kept if kind in BASE_KINDS else F.filter(kept, lambda s: s["score"] >= least)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))
    needed = {"email": "@", "phone": "+"}.get(kind)
    return F.when(F.contains(text, F.lit(needed)), spans).otherwise(none) if needed else spans


def find_personal_data(docs: DataFrame, least: float = 0.55) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and spans, an array of (kind, start, end, score), by kind, then start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*[kind_spans(text, k, least) for k in KINDS]).alias("spans"))


def redacted(text: Column, least: float = 0.55) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    spans = F.array_sort(
        F.transform(F.concat(*[kind_spans(text, k, least) for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(s["start"] >= done["at"], F.array_append(done["parts"], piece)).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("parts"))

    def joined(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(F.aggregate(s, start, step, joined)))


def digest(found: DataFrame) -> DataFrame:
    """The columns of op10's contract, from find_personal_data's rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    score = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), score.alias("top_score"))
