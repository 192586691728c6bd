"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and
further columns; each says below what becomes of them. Columns named like its working columns are kept.

Language ID rejects texts without letters or unlike every language; line dedup removes repeated
lines and documents that consist of nothing else; the Jaccard join keeps the first document of each
group of near copies; mixing takes documents to target weights; packing returns their pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import common, jaccard, language, lines, mixing, packing

#: Part of all tokens that the mixture takes, in percent; a document is taken once at most.
MIX_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; prototypes and the least cosine for each length are learned from the stage's own labelled rows.

    Null texts and texts without letters go, and without any labelled row all do. Repeated rows are judged alike.
    """
    langs, prototypes = language.train(docs)
    found = language.recognised(docs, langs, prototypes, language.floors(docs, langs, prototypes))
    return common.cut(found, "recognised", common.TEXT_ROWS)  # so that it is written in small Arrow batches


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those left without a word go, n_chars follows the text.

    Null and empty texts and rows without a doc_id stay as they are; repeated rows of a doc_id are changed alike.
    """
    removed = next(c for c in (f"removed_{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    out = lines.dedup_lines(docs, removed)
    emptied = F.col(removed).isNotNull() & (F.trim(F.col("text")) == "")
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without one and texts without words stay.

    Of a repeated doc_id one row stays: the first one in the order of all its columns as text.
    """
    firsts = jaccard.component_table(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    once, several = firsts.where("rows = 1").select("doc_id"), firsts.where("rows > 1").select("doc_id")
    order = F.struct(*(F.to_json(F.struct(c)) for c in docs.columns))
    tied = docs.join(several, "doc_id", "left_semi").select(*docs.columns)
    tied = tied.groupBy(F.col("doc_id").alias("__of")).agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return docs.join(once, "doc_id", "left_semi").select(*docs.columns).unionByName(tied).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes; one that the budget ends in is kept whole. Texts without words are never taken; rows without a doc_id stay."""
    taken = mixing.plan(docs, budget=F.floor(F.col("total") * MIX_PERCENT / 100).cast("long"), max_epochs=1, language_weights=mixing.LANGUAGE_WEIGHTS, domain_weights=mixing.DOMAIN_WEIGHTS)
    named = docs.join(taken.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    # rows without a doc_id cannot be told apart, so they stay
    return named.unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their sequences; null and empty texts are the end id alone."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("pack", pack)]

#: No SQL: language profiles, edit distances and the linear program cannot be said in it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.read(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/proofloom/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
