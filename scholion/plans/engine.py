"""The whole analysis as lazy tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholion.functions import clean as C
from scholion.operators import entities, repair, segment, structure
from scholion.plans import render

#: Adds ``ner``, and may add ``pos``, ``dep`` and ``head_id``, to (doc_id, para, sent, tok, text, start, stop).
Tagger = Callable[[DataFrame], DataFrame]


@dataclass
class Analysis:
    documents: DataFrame
    tokens: DataFrame
    mentions: DataFrame
    spans: DataFrame
    items: DataFrame

    @property
    def index(self) -> DataFrame:
        return structure.entity_index(self.items)

    @property
    def edges(self) -> DataFrame:
        return structure.edges(self.items)

    @property
    def addresses(self) -> DataFrame:
        return structure.addresses(self.items)

    @property
    def order(self) -> DataFrame:
        return structure.entity_order(self.documents)

    @property
    def html(self) -> DataFrame:
        return render.html(self.documents, self.spans)


def tagged_tokens(docs: DataFrame, tagger: Tagger = entities.rule_tags, cleaned: bool = False) -> DataFrame:
    """Cleaned texts to repaired tokens, white space left out; ``tok`` counts from 1 in a sentence."""
    text = docs if cleaned else docs.select("doc_id", C.currency(C.clean(F.col("text"))).alias("text"))
    toks = segment.tokens(text, rules=[segment.starts_rule(), segment.sentences_rule()]).where(~F.col("blank"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("tok"))
    toks = tagger(toks.withColumn("_n", number).drop("tok", "blank", "starts").withColumnRenamed("_n", "tok"))
    none = {"pos": "''", "dep": "''", "head_id": "0"}
    toks = toks.select("*", *(F.expr(v).alias(k) for k, v in none.items() if k not in toks.columns))
    return repair.repair(toks)


def analyse(docs: DataFrame, engine: str | Column = "modern", tagger: Tagger = entities.rule_tags, store: str | None = None) -> Analysis:
    """Documents (doc_id, text) to all tables; ``engine`` picks how mentions are read, ``modern`` or ``ancient``.

    A column of ``docs`` picks it for each document; all but ``modern`` are ``ancient`` then.

    With ``store``, a folder all executors share, the tables are written there as they
    are made, and each is computed once; without it they are lazy.
    """

    if isinstance(engine, Column):
        modern = F.coalesce(engine == "modern", F.lit(False))
        parts = [analyse(docs.where(on), name, tagger, store and f"{store}/{name}") for name, on in (("modern", modern), ("ancient", ~modern))]
        return Analysis(*(getattr(parts[0], f.name).unionByName(getattr(parts[1], f.name)) for f in fields(Analysis)))

    def kept(df: DataFrame, name: str) -> DataFrame:
        if store is None:
            return df
        df.write.mode("overwrite").parquet(f"{store}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{store}/{name}")

    text = kept(docs.select("doc_id", C.currency(C.clean(F.col("text"))).alias("text")), "documents")
    toks = kept(structure.heads(tagged_tokens(text, tagger, cleaned=True)), "tokens")
    found = entities.mentions_by_reading(toks) if engine == "modern" else entities.mentions_by_islands(toks)
    sents = toks.groupBy("doc_id", "sent").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).join(text, "doc_id")
    sents = sents.withColumn("text", F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start")))
    found = kept(entities.placed(found, sents, engine != "modern"), "mentions")
    return Analysis(text, toks, found, kept(entities.without_overlaps(found), "spans"), kept(structure.items(toks), "items"))
