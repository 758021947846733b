"""Registered queries of the training-data operators, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import binpack, chat, decontaminate, fingerprint, hard_negatives, html_extract, jaccard, langid, licenses, packing, quality, toxicity, whitening
from leafmill.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.labelled(table(spark, sf_dir, "embeddings"), moved), F.col("id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.digest(binpack.pack(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_jaccard, op3_fingerprint, op4_decontamination, op4_matches, op5_quality, op6_toxicity, op6_passages, op7_packing, op8_licenses, op9_html, op10_language, op11_negatives, op12_whitening, op13_binpack)}


_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Parts of 512 turns.
OP1_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
o AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) AS k FROM t),
r AS (SELECT *, k // 512 AS part FROM o),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
b AS (SELECT conv_id, part, string_agg('<|system|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS context
  FROM (SELECT p.conv_id, p.part, min(r.k) AS k, r.text FROM (SELECT DISTINCT conv_id, part FROM r) p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.part < p.part AND r.role = 'system' GROUP BY p.conv_id, p.part, r.text) GROUP BY conv_id, part),
p AS (SELECT r.conv_id, r.part, s.speaker, r.k, r.role = s.speaker AS own, r.text || '<|end|>' || chr(10) AS body,
  CASE WHEN r.role = s.speaker THEN '<|assistant|>' WHEN r.role = 'system' THEN '<|system|>' ELSE '<|user:' || r.role || '|>' END || chr(10) AS head
  FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
a AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY k) AS stop FROM p),
g AS (SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained, string_agg(head || body, '' ORDER BY k) AS rendered,
  coalesce(string_agg((stop - length(body))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (WHERE own), '') AS mask_spans
  FROM a GROUP BY conv_id, part, speaker)
SELECT g.conv_id, g.part, speaker, n_turns, n_trained, coalesce(context, '') AS context, rendered, mask_spans FROM g LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM g.conv_id AND b.part = g.part
"""

#: Exact: every pair that shares a shingle is counted; components by repeated reachability.
OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format(c="text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
t AS (SELECT a AS r, b AS o FROM l UNION SELECT t.r, l.b FROM t JOIN l ON t.o = l.a),
m AS (SELECT t.r, min(d.doc_id) AS low FROM t JOIN d ON d.r = t.o GROUP BY t.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(c="text")}, []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(c="text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.s, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM m) GROUP BY r),
t AS (SELECT r, list_sort(list_distinct(list(item_id))) AS items FROM m GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(len(t.items), 0) AS n_items,
  sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


#: Exact: every anchor meets every row.
OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS j FROM s WHERE same QUALIFY j <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.j ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op8_licenses": licenses.oracle_sql(), "op2_jaccard": OP2_SQL, "op4_decontamination": OP4_SQL, "op11_negatives": OP11_SQL}
