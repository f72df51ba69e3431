"""The registered queries of the text operators: thin digests of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocell.llm import bpe, common, decontaminate, filter_audit, html_text, katz, langid, packing, quality_rules, simhash, source_audit, substring_dedup, token_files, zstd_quality

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    token_files.write(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir), digest=True)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_bpe_round_trip, op2_token_files, op3_html_text, op4_language_id, op5_quality_rules, op6_katz_scores, op7_substring_dedup, op8_simhash_groups,
        op9_decontamination, op10_zstd_quality, op11_bin_slack_packing, op12_filter_audit, op13_source_audit,
    )
    return {f.__name__: f for f in ops}


def windows_sql() -> str:
    """Each word with its place, the window it starts, whether that occurs earlier, and so whether a window covers it."""
    follow = ", ".join(f"lead(word, {k}) OVER doc" for k in range(1, substring_dedup.WINDOW))
    back = substring_dedup.WINDOW - 1
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
 s AS (SELECT *, CASE WHEN i <= n - {back} THEN concat_ws(' ', word, {follow}) END AS win FROM w WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT *, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM s),
 c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS gone FROM r),
 g AS (SELECT doc_id, sum(gone) AS lost, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
 SELECT t.doc_id, len(ws) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)"""


def filters_sql() -> str:
    """Each document's five failures as a set of letters, each order of the letters step by step."""
    failed = ("len(ws) < 200", "100 * len(list_distinct(ws)) < 50 * len(ws)", "100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > least, false)")
    letters = " || ".join(f"CASE WHEN {f} THEN '{x}' ELSE '' END" for x, f in zip(filter_audit.FILTERS, failed))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 h AS (SELECT part, f, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic FROM (SELECT part, {letters} AS f, 1 AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)) GROUP BY part, f),
 x AS (SELECT unnest(string_split('{",".join(filter_audit.FILTERS)}', ',')) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT o, k, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
 p AS (SELECT part, o, k, x, f, n, good, toxic, contains(f, x) AS hit, before <> '' AND f <> '' AND regexp_matches(f, '[' || before || '0]') AS gone FROM h, s),
 r AS (SELECT part, o, k, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM p GROUP BY part, o, k, x)
 SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""


def sources_sql() -> str:
    """Kept terms of each language, each group's and language's share of each, and what they differ by."""
    upper, share = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", f"1 + {source_audit.UNIT} * (coalesce(n, 0)::HUGEINT + 2) // (total + 2 * v)"
    apart = "(p - q) * (p - q) // (p + q)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {source_audit.LEAST}),
 c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
 s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {share} AS p FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 l AS (SELECT lang, term, {share} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang) USING (lang)),
 b AS (SELECT a.lang, a.source, b.source AS item, sum({apart.replace("p", "a.p").replace("q", "b.p")}) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN b x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST({apart} AS BIGINT) FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
 z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
 SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= {source_audit.TOP}"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express: no trained model, tokenizer, XXH64 or edit distance."""
    return {"op7_substring_dedup": windows_sql(), "op12_filter_audit": filters_sql(), "op13_source_audit": sources_sql()}
