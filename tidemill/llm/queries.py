"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemill.llm.bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.decontam import find_leaks

    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.pii import digest, find_personal_data

    return digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.toxicity import grade_toxicity

    return grade_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.quality import grade_quality

    return grade_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.merkle import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


#: A conversation whose texts hold what templates use as control strings.
PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.chat import format_conversations, read_back

    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(planted)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemill.llm.tokencount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.neardup import embedding_components

    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_html_extraction": op4_html_extraction,
        "op5_fingerprints": op5_fingerprints,
        "op6_toxicity": op6_toxicity,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality": op8_quality,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_pii": op10_pii,
        "op11_embedding_neardup": op11_embedding_neardup,
        "op12_whitening": op12_whitening,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_decontamination": OP2_SQL, "op9_jaccard_join": OP9_SQL, "op10_pii": OP10_SQL, "op11_embedding_neardup": OP11_SQL, "op13_hard_negatives": OP13_SQL}


#: Every window of as many words as the item (or the whole document, if that has fewer) that shares a shingle with it.
OP2_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
runs AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM items WHERE len(w) >= 5),
held AS (SELECT x, count(DISTINCT item_id) AS k FROM runs GROUP BY x),
parts AS (SELECT r.item_id, r.n, r.x, count(*) AS own, ln(1 + (SELECT count(*) FROM items) / any_value(h.k)) AS weight FROM runs r JOIN held h USING (x) GROUP BY r.item_id, r.n, r.x),
whole AS (SELECT item_id, sum(own * weight) AS total FROM parts GROUP BY item_id),
placed AS (SELECT doc_id, len(w) - 4 AS many, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM docs WHERE len(w) >= 5),
weighed AS (SELECT doc_id, many, p, x, ln(1 + (SELECT count(*) FROM items) / coalesce(k, 1)) AS weight FROM placed LEFT JOIN held USING (x)),
summed AS (SELECT doc_id, p, sum(weight) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM weighed),
hits AS (SELECT DISTINCT d.doc_id, d.many, s.item_id, least(s.n - 4, d.many) AS m, d.p FROM placed d JOIN parts s USING (x)),
windows AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(greatest(p - m + 1, 0), least(p, many - m) + 1)) AS a FROM hits),
shared AS (SELECT v.doc_id, v.item_id, v.m, v.a, h.x, count(*) AS there FROM windows v JOIN (SELECT h.*, d.x FROM hits h JOIN placed d USING (doc_id, p)) h ON h.doc_id = v.doc_id AND h.item_id = v.item_id AND h.p BETWEEN v.a AND v.a + v.m - 1 GROUP BY ALL),
common AS (SELECT s.doc_id, s.item_id, s.m, s.a, sum(least(there, own) * weight) AS common FROM shared s JOIN parts USING (item_id, x) GROUP BY ALL),
scored AS (SELECT c.doc_id, c.item_id, c.m, c.a, common / (e.upto - coalesce(b.upto, 0) + total - common) AS similarity FROM common c JOIN whole USING (item_id)
  JOIN summed e ON e.doc_id = c.doc_id AND e.p = c.a + c.m - 1 LEFT JOIN summed b ON b.doc_id = c.doc_id AND b.p = c.a - 1),
best AS (SELECT doc_id, item_id, round(similarity, 9) AS similarity, a, m + 4 AS words FROM scored WHERE similarity >= 0.8 - 1e-9
  UNION ALL SELECT doc_id, item_id, 1.0, a, n FROM (SELECT d.doc_id, i.item_id, len(i.w) AS n, i.w AS v, d.w, unnest(range(0, len(d.w) - len(i.w) + 1)) AS a FROM docs d, items i WHERE len(i.w) BETWEEN 1 AND 4) WHERE w[a + 1:a + n] = v)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, arg_max(a, (similarity, -a))::BIGINT AS first_word, arg_max(words, (similarity, -a))::INT AS n_words FROM best GROUP BY doc_id, item_id
"""


OP9_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM cut
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id, s.s
"""


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER w AS before,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '<turn |</turn>|<part>')) AS shown,
    length(role) + length(regexp_replace(role, '[^\\>]', '', 'g')) + len(regexp_extract_all(role, '<turn |</turn>|<part>')) AS role_shown
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN before = role THEN length('<part>') ELSE role_shown + length('<turn >x</turn>x') END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


OP10_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(k, kind, pattern, own, near) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.8::DOUBLE, 'mail|contact|write|reach'),
  (2, 'ip', '[0-9]+(?:\.[0-9]+){3}', 0.6::DOUBLE, 'ip|address|host|server|from'),
  (3, 'card', '[0-9](?:[ -]?[0-9])+', 0.7::DOUBLE, 'card|visa|credit|debit|pay'),
  (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]', 0.6::DOUBLE, 'phone|tel|call|mobile|fax'),
  (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b', 0.7::DOUBLE, 'iban|account|bank|transfer'),
  (6, 'secret', '[A-Za-z0-9_-]{32,}', 0.4::DOUBLE, 'token|key|secret|password|passwd|credential')),
found AS (SELECT doc_id, text, k, kind, own, near, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps FROM docs, kinds),
placed AS (SELECT doc_id, text, k, kind, own, near, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS p, hits, gaps FROM found WHERE len(hits) > 0),
spans AS (SELECT doc_id, text, k, kind, own, near, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d,
  (list_sum(list_transform(gaps[1:p], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:p - 1], lambda h: length(h))), 0))::BIGINT AS b FROM placed),
checked AS (SELECT *, b + length(hit) AS e, own + CASE WHEN regexp_matches(lower(text[greatest(b - 39, 1):b]), '\b(?:' || near || ')') THEN 0.2::DOUBLE ELSE 0 END AS score,
  CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND right('000' || x, 3) <= '255'))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[length(d) - i + 1]::INT ELSE 2 * d[length(d) - i + 1]::INT - CASE WHEN d[length(d) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'secret' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    ELSE list_reduce(list_prepend(0, list_transform(string_split(replace(hit, ' ', '')[5:] || hit[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 END AS ok
  FROM spans),
kept AS (SELECT * FROM checked WHERE ok AND (k <= 4 OR score >= 0.55)),
each AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) FILTER (k <= 4) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) AS spans, max(score) AS top_score FROM kept GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, top_score FROM docs LEFT JOIN each USING (doc_id)
"""


OP11_SQL = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93
), reached AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.vec_id
), least AS (SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
