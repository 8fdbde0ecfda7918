"""The queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .exact_dedup import exact_duplicates
from .language import fit_text_model, identify, page_rows
from .line_dedup import drop_repeated_lines
from .packing import pack
from .passages import repeated_passages
from .recurrent import score_documents
from .secret_scan import BASE_KINDS, RULES, scan_secrets, spans_text
from .simhash import near_duplicates
from .token_counts import context_totals, length_histogram, token_lengths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(token_lengths(_table(spark, sf_dir, "documents"))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_text_model(_table(spark, sf_dir, "documents"))
    found = identify(page_rows(_table(spark, sf_dir, "pages")), model)
    return found.select(
        F.col("_id").alias("page_id"), "language", "confidence", "accepted", "text_language", "declared", "host"
    )


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(
        F.filter("found", lambda s: s["kind"] == kind)
    ).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(F.encode(spans_text(base), "UTF-8"), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), "contaminated"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_substring_dedup, op2_exact_dedup, op3_token_counts, op4_language_id, op5_recurrent_lm, op6_secret_scan,
            op7_decontamination, op8_best_fit_packing, op9_simhash, op10_line_dedup
        )
    }


_SQL_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
       FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
  FROM g
"""

_SQL_LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
       GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.*, r.last IS NOT NULL AND r.last <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_SQL_HITS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
     bl AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
     bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w
       FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM bl)),
     ms AS (SELECT DISTINCT m FROM bw),
     dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, ms WHERE len(ws) >= m)),
     h AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, w)),
     p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h)
       GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ','
       ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,
  0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)
         AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _sql_secrets() -> str:
    """Per rule, the strings between matches and the matches give the offsets."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern, keep = (x.replace("'", "''") for x in (rule.pattern, rule.keep))
        parts.append(
            f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))]) AS before, """
            f"unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i, '{keep}' AS keep FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     m AS ({' UNION ALL '.join(parts)}),
     o AS (SELECT *, sum(length(hit) + length(before)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
     s AS (SELECT doc_id, kind, rank, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM o
       WHERE regexp_matches(hit, keep)),
     t AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM s)
SELECT d.doc_id, {', '.join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE_KINDS)},
       sha256(coalesce(string_agg(span, ','
         ORDER BY start, rank) FILTER (kind IN {BASE_KINDS}), '')) AS base_sha256, coalesce(string_agg(span, ','
         ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": _SQL_DEDUP, "op6_secret_scan": _sql_secrets(), "op7_decontamination": _SQL_HITS,
        "op10_line_dedup": _SQL_LINES
    }
