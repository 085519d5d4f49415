"""The registered queries of this subpackage and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.decontaminate import contamination
from tarnspark.llm.divergence import source_divergence
from tarnspark.llm.jaccard_join import jaccard_components
from tarnspark.llm.line_dedup import dedup_lines
from tarnspark.llm.packing import pack_documents
from tarnspark.llm.periodic_runs import collapse_runs
from tarnspark.llm.personal_data import KINDS, find_personal_data
from tarnspark.llm.quality_classifier import score_documents
from tarnspark.llm.quality_rules import BASE, GAP, RULES, STOP_WORDS, score_quality
from tarnspark.llm.sharding import shard_documents
from tarnspark.scratch import scratch_path
from tarnspark.llm.substring_dedup import dedup_substrings
from tarnspark.llm.token_counts import document_token_counts
from tarnspark.llm.token_store import read_token_store, write_token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs).select("doc_id", *BASE, "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return document_token_counts(docs, scratch_path(spark, "token-files"), vocabulary())


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary())
    return read_token_store(spark, path)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten repeats itself from some word on, as its number decides."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.when(h % 10 == 0, F.filter(F.split(F.col("text"), GAP, -1), lambda w: w != ""))
    worded = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), split.alias("words"))
    n, g = F.size("words"), F.col("g")
    worded = worded.select("doc_id", "text", "words", F.when(n > 0, g % n).cast("int").alias("a"), F.when(n > 0, 1 + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return worded.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    top = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    share = F.call_function("div", F.col("top.length") * 1000, F.col("top.period"))
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period", share.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op9_token_store": op9_token_store,
    "op8_substring_dedup": op8_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_personal_data": op11_personal_data,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

LINE_ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def quality_sql(source: str = "documents") -> str:
    stops = ", ".join(f"'{w}', '{w.capitalize()}'" for w in STOP_WORDS)
    rules = " AND ".join(f"{part} * 100 {relation} {whole} * {percent}" for _, part, relation, percent, whole in RULES)
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {source}
), grams AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id
), counts AS (
  SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(body, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(body, '[^!]+', '', 'g')) AS n_shouts,
         length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, len(l) AS n_lines
  FROM split LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM judged
"""


JACCARD_ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)
), steps AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.r
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

SUBSTRING_ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM grams) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM repeated, range(50) AS t(d)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

DIVERGENCE_ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), per_doc AS (
  SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS whole FROM per_doc GROUP BY ALL HAVING count(*) >= 10
), cells AS (
  SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(langs.total, 0) AS lang_total, coalesce(own.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) own USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.whole + 2)) // (g.lang_total + 2 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), scored AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sums.value, 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums ON sums.lang = x.lang AND sums.source = x.source AND sums.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM scored
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


ORACLES: dict[str, str] = {
    "op12_source_divergence": DIVERGENCE_ORACLE,
    "op2_ngram_jaccard_join": JACCARD_ORACLE, "op3_line_dedup": LINE_ORACLE, "op4_quality_rules": quality_sql(), "op8_substring_dedup": SUBSTRING_ORACLE,
}
