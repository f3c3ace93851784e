"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import materialize, small_batches, table
from scholion.llm.decontam import contaminated, contamination
from scholion.llm.langid import fit, identify
from scholion.llm.lines import dedup_lines
from scholion.llm.packing import pack
from scholion.llm.queries import tokenizer_path
from scholion.llm.simhash import drop_near_copies


def _carried(docs: DataFrame) -> dict:
    """The columns of ``docs`` as one that passes an operator, whatever their names."""
    return {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or far from any language go."""
    small_batches(spark)
    found = identify(docs, fit(docs), extra=_carried(docs))
    return _back(found.where("not rejected"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; ``n_chars`` follows."""
    small_batches(spark)
    found = dedup_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else found


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a few hit words don't make one."""
    small_batches(spark)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), extra=_carried(docs))
    return _back(found.where(~contaminated()), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("packing", packed),
]

#: Languages, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
