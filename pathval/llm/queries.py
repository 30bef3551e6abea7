"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.llm import bpe_transducer, hilbert_shards, html_density, jaccard_join, language_id, line_dedup, lz_fingerprint, packing, quality_model, quality_rules
from pathval.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents``: counts, the base rule and the verdict on repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", quality_rules.repetition(F.col("text")).alias("m")).select("doc_id", "m.*")


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` to ids and back."""
    return bpe_transducer.production(spark, table(spark, sf_dir, "documents"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_density.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards along a curve over language, source and length."""
    return hilbert_shards.sharded(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


def quality_weights(docs: DataFrame, labels: DataFrame):
    """Weights learnt from labels whose fold of five is not 0; none of another table is read."""
    known = labels.where(fold("doc_id", 5) != 0).where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    return quality_model.fit(quality_model.sampled(docs, known))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_weights(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), quality_model.score(F.col("text"), weights, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents`` by a model of those whose fold of four is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    told = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), language_id.language(F.col("text"), model, spark).alias("l"))
    return told.select("doc_id", "held_out", "l.lang_pred", "l.score")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as pieces in sequences of at most 2048 tokens."""
    return packing.production(table(spark, sf_dir, "documents"))


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` by shingle sets of which three quarters agree."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines of repeated chunks."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition_rules, op2_bpe_transducer, op3_html_density, op4_hilbert_shards, op5_quality_classifier, op6_language_id, op7_certified_packing, op8_lz_fingerprint, op9_count_vector_join, op10_line_chunks)}


SQL = {
    "op10_line_chunks": r"""
WITH lines AS (
  SELECT DISTINCT doc_id, text, k, string_split(text, chr(10))[k] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k) WHERE text IS NOT NULL
), worded AS (
  SELECT *, lead(k) OVER w AS next_k, lead(line) OVER w AS next_line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id, text ORDER BY k)
), chunks AS (
  SELECT doc_id, text, k, next_k AS e, 2 AS n, line || chr(10) || next_line AS chunk FROM worded WHERE next_k IS NOT NULL
  UNION ALL SELECT doc_id, text, k, k, 1, line FROM worded WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY n, chunk ORDER BY coalesce(doc_id, -9223372036854775808), k) > 1 AS again FROM chunks
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(k, e + 1)) AS k FROM marked WHERE again
), cleaned AS (
  SELECT l.doc_id, l.text, coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS clean, count(g.k) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.k = g.k GROUP BY 1, 2
)
SELECT d.doc_id, coalesce(c.clean, d.text) AS text, coalesce(c.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cleaned c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
""",
}


def repetition_sql(limits: quality_rules.Limits = quality_rules.Limits()) -> str:
    """The measures of :func:`quality_rules.measure` by window functions over words and lines."""
    sizes = sorted({3, *limits.top, *limits.repeated})
    parts, joins, names, over = [], [], [], []
    for n in sizes:
        ahead = ", ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])
        parts.append(f"""g{n} AS (SELECT doc_id, i, concat_ws(' ', {ahead}) AS g, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS chars,
 i <= n - {n - 1} AS whole FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 c{n} AS (SELECT *, whole AND count(*) OVER p > 1 AS several, whole AND row_number() OVER q > 1 AS later, CASE WHEN whole THEN (count(*) OVER p - 1) * chars ELSE 0 END AS heavy FROM g{n}
 WINDOW p AS (PARTITION BY doc_id, whole, g), q AS (PARTITION BY doc_id, whole, g ORDER BY i)),
 i{n} AS (SELECT doc_id, i, heavy, max(several::INT) OVER b AS in_several, max(later::INT) OVER b AS in_later FROM c{n} WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
 m{n} AS (SELECT doc_id, max(heavy) AS heavy, sum(in_several) AS several, sum(in_later * length(word)) AS inside FROM i{n} JOIN words USING (doc_id, i) GROUP BY 1)""")
        joins.append(f"LEFT JOIN m{n} USING (doc_id)")
        if n in limits.top:
            names.append(f"coalesce(m{n}.heavy, 0)::BIGINT AS top_{n}_chars")
            over.append(f"100 * top_{n}_chars > {limits.top[n]} * word_chars")
        if n in limits.repeated:
            names.append(f"coalesce(m{n}.inside, 0)::BIGINT AS repeated_{n}_chars")
            over.append(f"100 * repeated_{n}_chars > {limits.repeated[n]} * word_chars")
    over += [f"100 * n_dup_lines > {limits.lines} * n_lines", f"100 * dup_line_chars > {limits.line_chars} * word_chars"]
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS later FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (later), 0) AS dup_line_chars FROM told GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY 1),
{", ".join(parts)},
a AS (SELECT doc_id, coalesce(t.n_words, 0)::BIGINT AS n_words, coalesce(t.word_chars, 0)::BIGINT AS word_chars,
 length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(m3.several, 0)::BIGINT AS n_repeat_words,
 coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(l.dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(names)}
 FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id) {" ".join(joins)}),
b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_words} * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR {" OR ".join(over)}) AS kept FROM b
"""


SQL["op1_repetition_rules"] = repetition_sql()
SQL["op9_count_vector_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM split, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM documents d JOIN reached r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
