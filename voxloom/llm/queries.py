"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, fill_in_middle, html_text, imatch, jaccard_join, neighbours, packing, periodic_runs, secret_scan, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, conversations, embeddings, pages, labels = map(_table, ("documents", "conversations", "embeddings", "pages", "labels"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op1(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(conversations(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op3(embeddings(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op4(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op5(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op6(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op7(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op10(pages(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op11(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op12(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.op13(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_chat_format,
        op3_nearest_neighbours,
        op4_fingerprints,
        op5_suffix_array_dedup,
        op6_token_counts,
        op7_byte_bpe,
        op8_best_fit_packing,
        op9_toxicity,
        op10_html_text,
        op11_secret_scan,
        op12_periodic_runs,
        op13_fill_in_middle,
        pipeline,
    )
}


def _secret_sql() -> str:
    """The forms, the samples, the models and the scores in SQL."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = {k: quote(p) for k, p in secret_scan.KINDS.items()}
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS nth, '{k}' AS kind, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM d" for i, (k, p) in enumerate(kinds.items())
    )
    n, prior, words = len(secret_scan.ALPHABET), secret_scan.PRIOR, quote(secret_scan.WORD)
    digests = [f"sha256(doc_id || ':{k}')" for k in range(secret_scan.DIGESTS)]
    made = ", ".join([*digests, *(f"rtrim(base64(unhex({d})), '=')" for d in digests)])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (
  SELECT doc_id, nth, kind, hits[i] AS hit,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
sample AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, {kinds['assign']}, ' ', 'g'), {kinds['access']}, ' ', 'g'), {kinds['hex']}, ' ', 'g') AS rest
  FROM d WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < {secret_scan.FIT_DOCS} / (SELECT count(*) FROM documents)::DOUBLE),
items AS (
  SELECT FALSE AS random, unnest(list_filter(regexp_extract_all(rest, {words}), lambda w: length(w) < {secret_scan.LEAST} OR regexp_matches(w, '{secret_scan.PLAIN}'))) AS item FROM sample
  UNION ALL SELECT TRUE, unnest([{made}]) FROM sample
  UNION ALL SELECT TRUE, unnest(regexp_extract_all(text, {kinds['access']})) FROM sample
  UNION ALL SELECT TRUE, unnest(regexp_extract_all(text, {kinds['hex']})) FROM sample),
pairs AS (
  SELECT random, a, b, sum(k) AS n FROM (
    SELECT random, k, CASE WHEN i = 1 THEN '' ELSE item[i - 1] END AS a, item[i] AS b
    FROM (SELECT *, unnest(range(1, length(item) + 1)) AS i FROM (SELECT random, item, count(*) AS k FROM items GROUP BY ALL)))
  GROUP BY ALL),
grid AS (
  SELECT a, b FROM (SELECT unnest(list_append(string_split('{secret_scan.ALPHABET}', ''), '')) AS a), (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS b)),
counts AS (
  SELECT g.a, g.b, coalesce(r.n, 0) AS r, coalesce(o.n, 0) AS o,
    sum(coalesce(r.n, 0)) OVER (PARTITION BY g.a) AS rs, sum(coalesce(o.n, 0)) OVER (PARTITION BY g.a) AS os,
    1 + sum(coalesce(r.n, 0)) OVER (PARTITION BY g.b) AS rb, 1 + sum(coalesce(o.n, 0)) OVER (PARTITION BY g.b) AS ob,
    {n} + sum(coalesce(r.n, 0)) OVER () AS rt, {n} + sum(coalesce(o.n, 0)) OVER () AS ot
  FROM grid g LEFT JOIN pairs r ON r.random AND r.a = g.a AND r.b = g.b LEFT JOIN pairs o ON NOT o.random AND o.a = g.a AND o.b = g.b),
weights AS (
  SELECT a, b, floor(1000 * (ln((r::DOUBLE + {prior} * rb::DOUBLE / rt::DOUBLE) / (rs::DOUBLE + {prior})) - ln((o::DOUBLE + {prior} * ob::DOUBLE / ot::DOUBLE) / (os::DOUBLE + {prior}))) + 0.5)::BIGINT AS w
  FROM counts),
scores AS (
  SELECT hit FROM (
    SELECT hit, CASE WHEN i = 1 THEN '' ELSE hit[i - 1] END AS a, hit[i] AS b FROM (SELECT hit, unnest(range(1, length(hit) + 1)) AS i FROM (SELECT DISTINCT hit FROM placed WHERE kind = 'markov')))
  JOIN weights USING (a, b) GROUP BY hit HAVING sum(w) >= {secret_scan.THRESHOLD} * max(length(hit))),
kept AS (
  SELECT *, kind || ':' || start || ':' || (start + length(hit)) AS span FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, {kinds['assign']}, 2)) >= {secret_scan.VALUE} WHEN 'markov' THEN hit IN (SELECT hit FROM scores) ELSE TRUE END)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, nth) FILTER (WHERE kind <> 'markov'), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, nth), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, length(role) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 24 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op11_secret_scan": _secret_sql(),
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
h AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS x FROM d),
cut AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""",
}
