"""Queries of the training-data operators over the driver tables, with SQL for DuckDB where it can say the same."""

import public_tokenizers
from pyspark.sql import functions as F

from thrustlog.llm import (
    bpe_codec, exact_dedup, fill_middle, html_content, packing, quality_rules, rank_bpe, ring_shards, simhash, spelling, token_counts,
    toxicity, url_rules,
)

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _vocabulary():
    return public_tokenizers.path(VOCABULARY)


def op1_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = toxicity.learned(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted",
        F.size("spans").alias("n_spans"),
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.decided(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir), _vocabulary(), limit=512)


def op4_packing(spark, sf_dir):
    return packing.packed(_documents(spark, sf_dir), _vocabulary(), size=1024, end_id=0)


def op5_ring_shards(spark, sf_dir):
    return ring_shards.digest(_documents(spark, sf_dir), shards=24)


def op6_simhash(spark, sf_dir):
    return simhash.grouped(_documents(spark, sf_dir), width=4, distance=4).select("doc_id", "fingerprint", "component_id")


def op7_bpe_codec(spark, sf_dir):
    return bpe_codec.code_digests(_documents(spark, sf_dir), _vocabulary())


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judged(_documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op9_html_content(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_content.extracted(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_url_rules(spark, sf_dir):
    return url_rules.judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling(spark, sf_dir):
    return spelling.variants(spelling.word_counts(_documents(spark, sf_dir)))


def op12_rank_bpe(spark, sf_dir):
    return rank_bpe.code_digests(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_fill_middle(spark, sf_dir):
    return fill_middle.digests(_documents(spark, sf_dir))


QUERIES = {
    query.__name__: query
    for query in (
        op1_toxicity, op2_exact_dedup, op3_token_counts, op4_packing, op5_ring_shards,
        op6_simhash, op7_bpe_codec, op8_quality_rules, op9_html_content, op10_url_rules,
        op11_spelling, op12_rank_bpe, op13_fill_middle,
    )
}


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quality_sql():
    bounds = []
    for measure, per, least, most in quality_rules.RULES.values():
        bounds += [f"{measure} >= {least} * {per}"] if least is not None else []
        bounds += [f"{measure} <= {most} * {per}"] if most is not None else []
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare,
    text, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d),
c AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: x IN ({_quoted(quality_rules.stop_forms())}))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-•*·]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM p),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM c WHERE n_words >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM t),
r AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
f AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(bounds)} AS kept
FROM f"""


_RULE_ROWS = ", ".join(
    f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in url_rules.ENTRIES
)

ORACLE = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op8_quality_rules": _quality_sql(),
    "op10_url_rules": rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(verdict, rule, host, path) AS (VALUES {_RULE_ROWS}),
m AS (
  SELECT h.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM h JOIN r ON ('.' || h.host) LIKE ('%.' || r.host) AND starts_with(h.path, r.path) GROUP BY h.page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p""",
}
