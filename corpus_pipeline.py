"""The corpus pipeline: quality rules, line dedup, near-copy removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.columns import put_aside
from tarnspark.llm.decontaminate import decontaminate
from tarnspark.llm.jaccard_join import keep_one_of_each
from tarnspark.llm.line_dedup import dedup_lines
from tarnspark.llm.packing import pack_documents
from tarnspark.llm.quality_rules import score_quality
from tarnspark.llm.queries import table, vocabulary
from tarnspark.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; the rules' counts do not take the place of columns of their names."""
    return score_quality(docs.select(F.struct("*").alias("__whole"), "text")).where("kept").select("__whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them; n_chars follows the text."""
    renamed, back = put_aside(docs, [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    left = dedup_lines(renamed).select(*renamed.columns).withColumnsRenamed(back)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL cannot express the packing stage; tests hold every stage against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
