"""Tokens to items: entity blocks with ids, remapped heads, trees, indexes and views.

Tokens are (doc_id, para, sent, tok, text, ner, pos, dep, head, head_id); ``tok`` counts from
1 in a sentence and ``head_id`` 0 is the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholion.operators.entities import NUMERIC

#: Marks that join a block without a space, and labels that a map shows.
MARKS = (".", ",", "'")
SPATIAL = ("GPE", "LOC", "FAC")
CORE = ("nsubj", "obj", "iobj", "root", "csubj", "ccomp", "xcomp")


def items(toks: DataFrame) -> DataFrame:
    """(doc_id, para, sent, id, is_ent, ent_id, text, ner, pos, dep, head, head_id).

    A block begins at B or S, or at any tag after none; I and E join it.  Entities
    are numbered through the document, and a head within a block is its first token.
    """
    sent = Window.partitionBy("doc_id", "sent").orderBy("tok")
    past = Window.unboundedPreceding, Window.currentRow
    tagged = F.coalesce("ner", F.lit("O")) != "O"
    starts = tagged & (F.col("ner").substr(1, 1).isin("B", "S") | ~F.coalesce(F.lag(tagged).over(sent), F.lit(False)))
    out = toks.withColumn("_e", tagged).withColumn("_s", starts)
    doc = Window.partitionBy("doc_id").orderBy("para", "sent", "tok").rowsBetween(*past)
    out = out.withColumn("ent_id", F.when(F.col("_e"), F.sum(F.col("_s").cast("int")).over(doc).cast("int")))
    block = F.max(F.when(F.col("_s") | ~F.col("_e"), F.col("tok"))).over(sent.rowsBetween(*past))
    out = out.withColumn("id", F.when(F.col("_e"), block).otherwise(F.col("tok")))
    label = F.when(F.length("ner") > 2, F.substring("ner", 3, 1000)).otherwise(F.col("ner"))
    label = F.when(label == "PERSON", "PER").otherwise(label)
    one = out.groupBy("doc_id", "para", "sent", "id", "ent_id").agg(
        F.array_sort(F.collect_list(F.struct("tok", "text"))).alias("_w"), F.min_by(label, F.col("tok")).alias("ner"),
        *(F.min_by(c, "tok").alias(c) for c in ("pos", "dep", "head", "head_id")),
    )
    to = out.select("doc_id", "sent", F.col("tok").alias("head_id"), F.col("id").alias("_to"))
    bare = lambda s, w: w["text"].isin(*MARKS) | F.col("ner").isin(*NUMERIC) & F.right(s, F.lit(1)).isin(*MARKS)
    text = F.aggregate(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), F.col("_w")[0]["text"], lambda s, w: F.when(bare(s, w), F.concat(s, w["text"])).otherwise(F.concat(s, F.lit(" "), w["text"])))
    one = one.join(to, ["doc_id", "sent", "head_id"], "left")
    return one.select("doc_id", "para", "sent", "id", F.col("ent_id").isNotNull().alias("is_ent"), "ent_id", text.alias("text"), "ner", "pos", "dep", "head", F.coalesce("_to", "head_id").alias("head_id"))


def heads(toks: DataFrame) -> DataFrame:
    """Adds ``head``: the text of the token that ``head_id`` names, ROOT if there is none."""
    at = toks.select("doc_id", "sent", F.col("tok").alias("head_id"), F.col("text").alias("_h"))
    named = toks.join(at, ["doc_id", "sent", "head_id"], "left")
    return named.select(*(c for c in toks.columns if c != "head"), F.coalesce("_h", F.lit("ROOT")).alias("head"))


def local_heads(toks: DataFrame) -> DataFrame:
    """``head_id`` within the sentence from ``head_doc``, a place in the document; a token that is its own head is the root."""
    first = F.min("doc_tok").over(Window.partitionBy("doc_id", "sent"))
    return toks.withColumn("head_id", F.when(F.col("head_doc") == F.col("doc_tok"), 0).otherwise(F.col("head_doc") - first + 1))


def entity_index(its: DataFrame) -> DataFrame:
    """(doc_id, label, entities array<struct<ent_id, text>>) in document order."""
    return its.where("is_ent").groupBy("doc_id", F.col("ner").alias("label")).agg(F.array_sort(F.collect_list(F.struct("ent_id", "text"))).alias("entities"))


def tree(toks: DataFrame) -> DataFrame:
    """(doc_id, paragraphs): tokens in sentences in paragraphs; empty sentences vanish."""
    by_sent = toks.groupBy("doc_id", "para", "sent").agg(F.array_sort(F.collect_list(F.struct("tok", "text", "ner"))).alias("tokens"))
    by_para = by_sent.groupBy("doc_id", "para").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent", "tokens"))), lambda s: s["tokens"]).alias("sents"))
    return by_para.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "sents"))), lambda p: p["sents"]).alias("paragraphs"))


def tokens_by_sentence(sents: DataFrame, toks: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens): a sentence without tokens keeps an empty list."""
    held = toks.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("tok", "text"))).alias("tokens"))
    return sents.select("doc_id", "sent").join(held, ["doc_id", "sent"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<tok:int,text:string>>")))


def addresses(its: DataFrame) -> DataFrame:
    """Adds ``address``, paragraph.sentence.word from 1; punctuation is counted but left out."""
    sent = F.dense_rank().over(Window.partitionBy("doc_id", "para").orderBy("sent"))
    word = F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("id"))
    return its.withColumn("address", F.concat_ws(".", F.col("para") + 1, sent, word)).where(F.coalesce("pos", F.lit("")) != "PUNCT")


def edges(its: DataFrame) -> DataFrame:
    """(doc_id, sent, id, head_id, dep, is_ent, head_is_ent): words and the other item in their sentence that is their head."""
    at = its.select("doc_id", "sent", F.col("id").alias("head_id"), F.col("is_ent").alias("head_is_ent"))
    return its.where("id <> head_id").select("doc_id", "sent", "id", "head_id", "dep", "is_ent").join(at, ["doc_id", "sent", "head_id"]).select("doc_id", "sent", "id", "head_id", "dep", "is_ent", "head_is_ent")


def mind_map(its: DataFrame, mode: str = "neighbours") -> DataFrame:
    """Edges by view: ``entities`` between entities, ``neighbours`` that touch one, ``core`` of the main relations, ``summary`` the last two together."""
    found = edges(its)
    touch, core = F.col("is_ent") | F.col("head_is_ent"), F.regexp_replace("dep", ":.*", "").isin(*CORE)
    return found.where({"entities": F.col("is_ent") & F.col("head_is_ent"), "neighbours": touch, "core": core, "summary": touch & core}[mode])


def places(its: DataFrame) -> DataFrame:
    """(label, text, n, docs) of entities that a map can show."""
    return its.where(F.col("is_ent") & F.col("ner").isin(*SPATIAL)).groupBy(F.col("ner").alias("label"), "text").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def by_category(its: DataFrame, hidden: list[str]) -> DataFrame:
    """Without the entities of hidden labels."""
    return its.where(~F.coalesce(F.col("is_ent") & F.col("ner").isin(hidden), F.lit(False)))


def with_entity_ids(saved: DataFrame) -> DataFrame:
    """Upgrades old items (doc_id, ord, is_ent, ner, text, ent_id): PERSON is PER, and a missing id is the next one free.

    An id that is there is kept, and the next one free exceeds all so far, each of which used one at least.
    """
    past = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.col("is_ent").cast("int")).over(past)
    # after an entity the next id is max(next, id) + 1: the n-th is n plus the largest lead that a given id took
    lead = F.coalesce(F.max(F.when(F.col("is_ent"), F.col("ent_id") - F.col("_n"))).over(past), F.lit(0))
    out = saved.withColumn("_n", n).withColumn("_m", F.greatest(lead, F.lit(0)))
    out = out.withColumn("ent_id", F.when(F.col("is_ent"), F.coalesce("ent_id", (F.col("_n") + F.col("_m")).cast("int"))))
    return out.withColumn("ner", F.when(F.col("is_ent") & (F.col("ner") == "PERSON"), "PER").otherwise(F.col("ner"))).drop("_n", "_m")


def entity_order(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_order): an order of entities of the user's own, of which there is none; saved analyses have the place."""
    return docs.select("doc_id", F.array().cast("array<string>").alias("entity_order"))
