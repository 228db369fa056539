"""Corpus pipeline: quality rules, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one as Parquet in
the shared folder and rereads it as the next one's docs. All but the last return the columns of
documents, whatever they are; a text that changes also changes n_chars, if there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import bpe, common, line_dedup, mixing, ngram_join, quality_rules

#: Near duplicates within the pipeline: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged by itself and carries its verdict,
    so rows that repeat or share ids keep their own; null and empty texts fail; a null source is one
    host; no rows give no rows."""
    carried = docs.withColumn("q_carried", F.col("text"))
    kept = quality_rules.judge(carried).where("kept")
    return kept.select(*(F.col("q_row.q_carried").alias(c) if c.lower() == "text" else F.col(f"q_row.`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; emptied ones stay, as empty, and
    null texts become empty. Rows of one doc_id are one holder; a null doc_id comes last."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, some of docs, with one row of each doc_id and text; of rows that differ in their other
    columns, the least by those. Rows without doc_id all stay. Only repeated ids are grouped."""
    many = common.save(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    if many.isEmpty():
        return rows
    others = F.to_json(F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text"))))
    held = rows.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns)).alias("o_row"), others.alias("o_others"))
    once = held.join(many, "doc_id").groupBy("doc_id", "text").agg(F.min_by("o_row", "o_others").alias("o_row")).select("o_row.*")
    return rows.join(many, "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, and one row of it
    for each text, if rows repeat under its doc_id. Rows without doc_id are in no group and stay;
    so do null and empty texts, which are like no other."""
    found = ngram_join.jaccard_components(docs.select("doc_id", "text"), WORDS, PERCENT)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return _once(docs, docs.join(gone, "doc_id", "left_anti").select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeats as repeated rows; the document at a source's cut comes whole if
    at least half of it is inside. Documents without words take none of the budget and go."""
    return mixing.emit(docs, mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digest and that of the decoded bytes; null text has none."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near), ("source_mixing", mix), ("byte_bpe", tokens)]

#: Near duplicates and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        there = common.taken_paths()
        out = stage(spark, docs, sf_dir)
        used = [p for p in common.taken_paths() if p not in there]
        path = common.scratch(spark, f"stage-{name}")
        schema = out.schema
        out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        # the rows are written: what they were made of may go
        common.release_paths(used + ([(spark, before)] if before else []))
        before = path
    return docs
