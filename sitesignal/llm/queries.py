"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesignal.llm.divergence import LEAST_DOCS, TERM_RANKS, source_divergence
from sitesignal.llm.langid import identify
from sitesignal.llm.linededup import dedup_lines
from sitesignal.llm.mixing import NONE, SWEEPS, TEMPER, TOPIC, mix
from sitesignal.llm.neardup import near_duplicates
from sitesignal.llm.negatives import hard_negatives
from sitesignal.llm.packing import pack
from sitesignal.llm.rules import RULES, STOP_WORDS, judge
from sitesignal.llm.sharding import shard
from sitesignal.llm.simhash import simhash_components
from sitesignal.llm.spots import edited_fingerprints
from sitesignal.llm.tokens import prefix_token_counts, truncated
from sitesignal.llm.toxicity import rate


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark, sf_dir):
    counts = truncated(prefix_token_counts(documents(spark, sf_dir)), 1024)
    return counts.withColumn("over_limit", F.col("prefix_chars") < F.col("n_chars"))


def op2_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))


def op3_language(spark, sf_dir):
    return identify(documents(spark, sf_dir))


def op4_fingerprints(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "removed_lines")


def op7_mixing(spark, sf_dir):
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "lang", "topic", "weight", F.round("p", 9).alias("p"), "sampled")


def op8_toxicity(spark, sf_dir):
    return rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark, sf_dir):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(documents(spark, sf_dir)).select("doc_id", *columns)


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark, sf_dir):
    return source_divergence(documents(spark, sf_dir))


def op13_simhash(spark, sf_dir):
    return simhash_components(documents(spark, sf_dir))


LLM_QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_simhash": op13_simhash,
}
_STOP = "', '".join(STOP_WORDS)

QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM places
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL) AS x
  WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(list_filter(w, lambda x: x IN ('{_STOP}'))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_list_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(…|[.]{{3}})\\s*$'))) AS n_open_lines,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT ({' OR '.join(
    f"coalesce({side}, false)"
    for r in RULES
    for side in ([f"{r.value} < {r.least}"] if r.least is not None else [])
    + ([f"{r.value} > {r.most}"] if r.most is not None else [])
  )}) AS kept
FROM m
"""


def mixing_sql() -> str:
    """The sweeps written out, one table after the other."""
    names = ("source", "lang", "topic")
    wants = ", ".join(f"power(sum(w) OVER (PARTITION BY {n}) / sum(w) OVER (), {TEMPER}) AS want_{n}, count(*) OVER (PARTITION BY {n}) AS n_{n}" for n in names)
    norms = ", ".join(f"want_{n} / sum(want_{n} / n_{n}) OVER () AS want_{n}" for n in names)
    steps, at = [], "r0"
    for sweep in range(SWEEPS):
        for n in names:
            to = f"r{sweep}{n}"
            keep = ", ".join(["source", "lang", "topic", "w", *(f"want_{x}" for x in names)])
            steps.append(f"{to} AS (SELECT {keep}, r * want_{n} / sum(r) OVER (PARTITION BY {n}) AS r FROM {at})")
            at = to
    return f"""
WITH rows AS (
  SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS s, coalesce(lang, '{NONE}') AS l, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS weight,
    {TOPIC} AS topic,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
  FROM documents),
cells AS (SELECT s AS source, l AS lang, topic, CAST(sum(weight) AS DOUBLE) AS w FROM rows GROUP BY ALL),
wanted AS (SELECT source, lang, topic, w, {wants} FROM cells WHERE w > 0),
r0 AS (SELECT source, lang, topic, w, {norms}, w / sum(w) OVER () AS r FROM wanted),
{", ".join(steps)},
p AS (SELECT source, lang, topic, (r / w) / max(r / w) OVER () AS p FROM {at})
SELECT doc_id, rows.source, rows.lang, rows.topic, weight, round(CASE WHEN weight = 0 THEN 1 ELSE p.p END, 9) AS p,
  weight = 0 OR u < p.p AS sampled
FROM rows LEFT JOIN p ON p.source = s AND p.lang = l AND p.topic = rows.topic
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
seen AS (SELECT id, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM seen GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
cells AS (
  SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM seen SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n
  FROM g LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source GROUP BY ALL),
p AS (
  SELECT kept.lang, totals.source, kept.term, coalesce(cells.n, 0) AS n,
    1 + (1000000000 * (coalesce(cells.n, 0) + 1)) // (totals.n + v.v) AS p
  FROM kept JOIN totals ON totals.lang = kept.lang JOIN v ON v.lang = kept.lang
  LEFT JOIN cells ON cells.lang = kept.lang AND cells.source = totals.source AND cells.term = kept.term),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)) // (whole + v) AS q
  FROM cells JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS whole FROM totals GROUP BY lang) AS w USING (lang)
  GROUP BY lang, term, whole, v),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TERM_RANKS}
"""


LLM_ORACLE: dict[str, str] = {
    "op7_mixing": mixing_sql(),
    "op9_quality_rules": QUALITY_SQL,
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_source_divergence": DIVERGENCE_SQL,
}
