"""A corpus from documents: five stages, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe import bpe_encode
from lattica.llm.common import fresh, read, stored
from lattica.llm.decontaminate import search
from lattica.llm.line_dedup import rest_of_lines
from lattica.llm.ngram_join import ngram_jaccard_join
from lattica.llm.quality_rules import quality_rules
from lattica.llm.queries import WORD_BPE, vocabulary



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows alike in id, text and source, by a key of 128 bits, fare alike."""
    r1, r2 = fresh(docs, "r1", "r2")
    rows = docs.withColumns({r1: F.xxhash64("doc_id", "text", "source"), r2: F.xxhash64(F.lit("row"), "doc_id", "text", "source")})
    judged = quality_rules(rows.select(F.col(r1).alias("doc_id"), F.col(r2).alias("r2"), "text", "source"), key="r2")
    kept = judged.where("kept").select(F.col("doc_id").alias(r1), F.col("r2").alias(r2)).distinct()
    return rows.join(kept, [r1, r2], "left_semi").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occurred before; n_chars follows the text."""
    found, name = rest_of_lines(docs)
    rest = F.col(f"{name}.rest")
    new = {"text": rest.alias("text"), "n_chars": F.length(rest).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select([new.get(x, F.col(x)) for x in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of five words and 0.8 hold together.

    Rows alike in id and text are one document. Those without an id are documents like
    others, told apart by text; in a group they come after all ids.
    """
    (row,) = fresh(docs, "r1")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    ids = stored(rows.groupBy(row).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = ngram_jaccard_join(rows.select(F.col(row).alias("doc_id"), "text"))
    grouped = found.groupBy(F.col("doc_id").alias(row)).agg(F.min("component_id").alias("component_id")).join(ids, row)
    kept = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first")).select(f"first.{row}")
    left = rows.join(kept, row, "left_semi").select(docs.columns)
    # without a repeated row there is nothing to drop, and no shuffle of the texts
    return left.dropDuplicates(["doc_id", "text"]) if ids.where("n > 1").limit(1).count() else left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found, name = search(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col(f"{name}.contaminated")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe_encode(docs, vocabulary(WORD_BPE), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("bpe encoding", encoding),
]

#: SQL cannot express the third and the last stage; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
