"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import (
    exact_dedup,
    html_density,
    lm_score,
    minhash,
    mix_wfq,
    packing,
    secret_scan,
    token_counts,
    topk_mtree,
    toxicity,
)
from loomgraph.llm.common import documents


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_wfq.mix(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), width=3, threshold=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(documents(spark, sf_dir))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents),
per AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY key, source),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () * 1.5 - 2 * coalesce(sum(source_size) OVER earlier, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS level
  FROM per WINDOW earlier AS (ORDER BY source_size * 2 / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT key, source_size, least(CAST(source_size * 2 AS DOUBLE), weight * max(level) OVER ()) AS target,
         CAST(sum(source_size) OVER () * 1.5 AS DOUBLE) AS budget
  FROM filled),
queued AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY key ORDER BY place, doc_id NULLS FIRST, size
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sent
  FROM sizes JOIN plan USING (key)),
copies AS (
  SELECT *, (sent + source_size * copy) / target AS finish
  FROM queued, (VALUES (0), (1)) AS c(copy) WHERE size > 0),
cut AS (
  SELECT max(finish) AS last FROM (
    SELECT finish, budget, sum(size) OVER (ORDER BY finish, key, place, doc_id, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle
    FROM copies) WHERE middle <= budget)
SELECT doc_id, size, source_size, coalesce(target, 0.0) AS target,
       CAST(CASE WHEN size > 0 AND sent / target <= last THEN size ELSE 0 END
          + CASE WHEN size > 0 AND (sent + source_size) / target <= last THEN size ELSE 0 END AS BIGINT) AS taken
FROM queued, cut
"""

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT row_no, doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
classes AS (
  SELECT row_number() OVER () AS class, same.* FROM (
    SELECT list_sort(s) AS s, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)) AS same),
items AS (SELECT class, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b
  FROM items AS a JOIN items AS b ON a.x = b.x AND a.class < b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT class AS a, class AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reach AS r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) AS l ON r.b = l.a),
named AS (SELECT r.a AS class, min(c.first) AS component FROM reach AS r JOIN classes AS c ON r.b = c.class GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(n.component, s.doc_id) AS component_id,
       s.doc_id = coalesce(n.component, s.doc_id) AS kept
FROM sets AS s LEFT JOIN classes AS c ON list_sort(s.s) = c.s LEFT JOIN named AS n ON c.class = n.class
"""


def _spans_sql(number: int, rule: secret_scan.Rule) -> str:
    """The spans of one rule: row_no, k, kind, s (its start), m (its text). A start is the
    length of all matches before and all gaps up to it."""
    either = lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1])  # noqa: E731  (RE2 folds beyond ASCII)
    pattern = "'" + re.sub(r"\(\?i:([^)]*)\)", either, rule.pattern).replace("'", "''") + "'"
    counted = f"regexp_extract(ms[j], {pattern}, {rule.group})"
    return f"""
  SELECT row_no, {number} AS k, '{rule.kind}' AS kind, ms[j] AS m,
         CAST(list_sum(list_transform(gaps[1:j], lambda x: length(x)))
            + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM (
    SELECT row_no, regexp_extract_all(t, {pattern}) AS ms, regexp_split_to_array(t, {pattern}) AS gaps
    FROM texts WHERE regexp_matches(t, {pattern})))
  WHERE length({counted}) >= {rule.least}"""


OP6_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({"  UNION ALL".join(_spans_sql(i, r) for i, r in enumerate((*secret_scan.BASE, *secret_scan.MORE)))}),
named AS (SELECT row_no, k, s, kind || ':' || s || ':' || (s + length(m)) AS name FROM found),
per AS (
  SELECT row_no, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
         string_agg(name, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(name, ',' ORDER BY s, k) AS spans
  FROM named GROUP BY row_no)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (row_no)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_topk": op1_mtree_topk,
    "op2_toxicity": op2_toxicity,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_text": op5_html_text,
    "op6_secret_scan": op6_secret_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {
    "op1_mtree_topk": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_secret_scan": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_minhash": OP8_SQL,
}
