"""Tag sequences to mentions, their clean-up, spans and the overlap filter."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from scholion.operators import segment

# Fixed values.
JOINERS = (".", ",", "/", "-", "'")
NUMERIC = ("CARDINAL", "MONEY", "QUANTITY")
PREPOSITIONS = "από|έως|μέχρι|στις|στα|στον|στην|στο"
LAW_LEAD = r"(?:(?:άρθ\.|άρθρο|αρθ\.|αρθ|παρ\.|παράγραφος)\s*\d+[α-ωΑ-Ω]?\s*(?:του\s*|της\s*)?)+"
LAW_WORDS = ("/", "-", ".", ",", "'", "ν", "ν.", "αρθρο", "αρθρ.", "§", "παρ", "παρ.")
CURRENCY = ("€", "$", "£", "¥")


def prefix(ner: Column) -> Column:
    return F.when(ner.rlike("^[BIES]-"), F.substring(ner, 1, 1)).when(ner == "O", "O").otherwise("S")


def label(ner: Column) -> Column:
    """Upper-case label without prefix; PERSON is PER."""
    up = F.upper(F.regexp_replace(ner, "^[BIES]-", ""))
    return F.when(up == "PERSON", "PER").otherwise(up)


def joined(words: Column, glue_after: Column | None = None) -> Column:
    """An array of struct(text, punct) as one text: no space before or after marks, or where the text so far ends in one."""
    glue = F.lit(False) if glue_after is None else glue_after
    return F.aggregate(
        words, F.lit(""),
        lambda s, w: F.when(s == "", w["text"]).when(w["punct"] | glue & F.right(s, F.lit(1)).isin(*JOINERS), F.concat(s, w["text"])).otherwise(F.concat(s, F.lit(" "), w["text"])),
    )


def mentions_by_islands(toks: DataFrame) -> DataFrame:
    """(doc_id, sent, first, label, text, dep, head, start, stop) of plain B, I, E, S tags.

    B and S begin a mention, I and E go on with the one that is open, E and O end
    it; what goes on with nothing is dropped.
    """
    by = Window.partitionBy("doc_id", "sent").orderBy("tok")
    out = toks.withColumn("_p", prefix(F.col("ner")))
    before = F.lag("_p").over(by)
    new = before.isNull() | F.col("_p").isin("O", "B", "S") | before.isin("O", "E", "S")
    out = out.withColumn("_n", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    word = F.struct("tok", "text", F.col("text").isin(*JOINERS).alias("punct"))
    found = out.where("_p <> 'O'").groupBy("doc_id", "sent", "_n").agg(
        F.min("tok").alias("first"), F.min_by("_p", "tok").alias("_p"), F.min_by(label(F.col("ner")), F.col("tok")).alias("label"), F.array_sort(F.collect_list(word)).alias("_w"),
        F.min_by("dep", "tok").alias("dep"), F.min_by("head", "tok").alias("head"), F.min("start").alias("start"), F.max("stop").alias("stop"),
    )
    found = found.where(F.col("_p").isin("B", "S"))
    return found.select("doc_id", "sent", "first", "label", joined(F.col("_w"), F.lit(True)).alias("text"), "dep", "head", "start", "stop")


class _Open:
    """The mention being read."""

    def __init__(self, tok: dict, label: str) -> None:
        self.label, self.text, self.first, self.last = label, tok["text"], tok, tok

    def add(self, tok: dict, bare: bool) -> None:
        self.text += tok["text"] if bare else " " + tok["text"]
        self.last = tok

    def done(self) -> dict:
        return {"text": self.text, "label": self.label, "dep": self.first["dep"], "head": self.first["head"], "start": self.first["start"], "stop": self.last["stop"], "first": self.first["tok"]}


def _goes_on(open_: str, new: str) -> bool:
    """Whether a number-like label continues an open one."""
    return open_ == new or {open_, new} == {"CARDINAL", "MONEY"} or "LAW" in (open_, new) and (new if open_ == "LAW" else open_) in ("DATE", "CARDINAL")


def _connects(label: str, text: str) -> bool:
    """Whether an untagged token belongs inside a mention of this label."""
    if label == "DATE":
        return text in ("/", "-", ".")
    if label == "MONEY":
        return text.isdigit() or text in (",", ".", *CURRENCY)
    return label == "LAW" and (text.isdigit() or text.lower() in LAW_WORDS)


class Reader:
    """The modern assembler: dates, amounts and law references grow over connectors and each other.

    Tokens of one sentence go in one after the other; mentions come out as they end.
    """

    def __init__(self) -> None:
        self.now: _Open | None = None

    def flush(self) -> Iterator[dict]:
        if self.now is not None:
            yield self.now.done()
        self.now = None

    def read(self, t: dict) -> Iterator[dict]:
        now, text, tag = self.now, t["text"], t["ner"] or "O"
        bare = t["pos"] in ("PUNCT", "SYM") or text.startswith(JOINERS) or now is not None and now.text.endswith(JOINERS)
        parts = tag.split("-")
        kind, name = (parts[0] if len(parts) == 2 else "S"), parts[-1].upper()
        name = "PER" if name == "PERSON" else name
        if tag == "O":
            if now is not None and _connects(now.label, text):
                now.add(t, bare or now.label != "LAW")
            else:
                yield from self.flush()
        elif name in ("DATE", "LAW", "MONEY", "CARDINAL"):
            if now is not None and _goes_on(now.label, name):
                if now.label in ("CARDINAL", "DATE") and name in ("MONEY", "LAW"):
                    now.label = name
                now.add(t, bare)
            else:
                yield from self.flush()
                self.now = _Open(t, name)
        elif kind in "BS":
            yield from self.flush()
            self.now = _Open(t, name)
            if kind == "S":
                yield from self.flush()
        elif now is not None:
            now.add(t, text in JOINERS or now.label in NUMERIC and now.text.endswith(JOINERS))
            if kind == "E":
                yield from self.flush()


def read_mentions(toks: list[dict]) -> list[dict]:
    reader = Reader()
    return [m for t in toks for m in reader.read(t)] + list(reader.flush())


_WORD = ["tok", "text", "ner", "pos", "dep", "head", "start", "stop"]


def mentions_by_reading(toks: DataFrame) -> DataFrame:
    """The columns of ``mentions_by_islands`` from the modern assembler; sentences stream past, sorted."""
    kind = {c: toks.schema[c].dataType for c in ("doc_id", "sent", "tok", "start", "stop")}
    fields = [("doc_id", kind["doc_id"]), ("sent", kind["sent"]), ("first", kind["tok"]), *((c, T.StringType()) for c in ("label", "text", "dep", "head")), ("start", kind["start"]), ("stop", kind["stop"])]
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, Reader()
        for batch in batches:
            out: list[tuple] = []

            def keep(found: Iterator[dict], out=out) -> None:
                out.extend((*key, *(m[c] for c in names[2:])) for m in found)

            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if key is not None:
                        keep(reader.flush())
                    key = row[:2]
                keep(reader.read(dict(zip(_WORD, row[2:], strict=True))))
            yield _mentions(out, names, batch.schema)
            kinds = batch.schema
        if key is not None:
            yield _mentions([(*key, *(m[c] for c in names[2:])) for m in reader.flush()], names, kinds)

    dealt = toks.select("doc_id", "sent", *_WORD).repartition("doc_id", "sent").sortWithinPartitions("doc_id", "sent", "tok")
    return dealt.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in fields]))


def _mentions(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    kinds = [schema.field({"first": "tok", "label": "ner"}.get(n, n)).type for n in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def trimmed(text: Column, label: Column, sentence: Column | None = None, ancient: bool = False) -> Column:
    """A mention's text by its label: amounts, dates and law references lose what hangs on, and take what precedes them in the sentence."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    money = F.regexp_replace(bare, "[ .,;/-]+$", "")
    date = F.regexp_replace(F.regexp_replace(money, rf"(?iuU)\s+(?:{PREPOSITIONS})$", ""), rf"(?iuU)^(?:{PREPOSITIONS})\s+", "")
    law = F.regexp_replace(bare, "[ .,;/)-]+$", "")
    if sentence is not None:
        quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        grown = F.regexp_substr(sentence, F.concat(F.lit(r"(?iuU)\d+\s*"), quoted(date)))
        date = F.when(date.rlike(r"^[/.\-]"), F.coalesce(grown, date)).otherwise(date)
        if not ancient:
            law = F.coalesce(F.regexp_substr(sentence, F.concat(F.lit(f"(?iuU){LAW_LEAD}"), quoted(law))), law)
    return F.when(label == "MONEY", money).when(label == "DATE", date).when(label == "LAW", law).otherwise(text)


def placed(found: DataFrame, sents: DataFrame, ancient: bool = False) -> DataFrame:
    """Mentions with the span and text that are left of them, or that they grow to, in their sentence.

    ``sents`` are (doc_id, sent, start, text).  ``start`` and ``stop`` move with what
    ``trimmed`` cuts off and with the number before a date or the article before a
    law that it takes in; the text is that between them, as it stands there.
    """
    whole = sents.select("doc_id", "sent", F.col("start").alias("_a"), F.col("text").alias("_s"))
    out = found.join(whole, ["doc_id", "sent"])
    out = out.withColumn("_r", F.substr("_s", F.col("start") - F.col("_a") + 1, F.col("stop") - F.col("start")))
    out = out.withColumn("_t", trimmed(F.col("_r"), F.col("label"), None, ancient))
    out = out.withColumn("_f", F.col("start") + F.greatest(F.instr("_r", F.col("_t")) - 1, F.lit(0)))
    before = F.substr("_s", F.lit(1), F.col("_f") - F.col("_a"))
    lead = F.when((F.col("label") == "DATE") & F.col("_t").rlike(r"^[/.\-]"), F.regexp_extract(before, r"(?U)(\d+\s*)$", 1))
    lead = lead if ancient else lead.when(F.col("label") == "LAW", F.regexp_extract(before, f"(?iuU)({LAW_LEAD})$", 1))
    out = out.withColumn("_g", F.length(F.coalesce(lead, F.lit(""))))
    out = out.withColumn("start", (F.col("_f") - F.col("_g")).cast(found.schema["start"].dataType))
    out = out.withColumn("stop", (F.col("_f") + F.length("_t")).cast(found.schema["stop"].dataType))
    out = out.where(F.col("start") < F.col("stop")).withColumn("text", F.substr("_s", F.col("start") - F.col("_a") + 1, F.col("stop") - F.col("start")))
    return out.select(*found.columns)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Of each document's spans, from left to right, those that begin at or after the end of the last one kept.

    Rows are (doc_id, start, stop, ..); equal starts keep the order of ``first``.
    A document's spans stream past; none are gathered.
    """
    names = spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, end = object(), -1
        for batch in batches:
            keep = []
            for d, a, b in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "start", "stop")), strict=True):
                if d != doc:
                    doc, end = d, -1
                keep.append(a >= end)
                end = b if a >= end else end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start", "first").mapInArrow(run, spans.schema)


def project_spans(toks: DataFrame, spans: DataFrame) -> DataFrame:
    """Tags tokens by character spans: the first token that a span overlaps is B, others I; the last span wins.

    ``spans`` are (doc_id, sent, ord, start, stop, label).
    """
    s = spans.select(F.col("doc_id").alias("_d"), F.col("sent").alias("_s"), "ord", F.col("start").alias("_a"), F.col("stop").alias("_b"), "label")
    met = toks.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s")) & (F.col("_a") < F.col("stop")) & (F.col("start") < F.col("_b")))
    first = F.min("tok").over(Window.partitionBy("doc_id", "sent", "ord"))
    tag = F.when(F.upper("label") == "LABEL_0", "O").otherwise(F.concat(F.when(F.col("tok") == first, "B-").otherwise("I-"), F.coalesce("label", F.lit("MISC"))))
    best = met.withColumn("_t", tag).groupBy("doc_id", "sent", "tok").agg(F.max_by("_t", "ord").alias("_t"))
    return toks.drop("ner").join(best, ["doc_id", "sent", "tok"], "left").withColumn("ner", F.coalesce("_t", F.lit("O"))).drop("_t")


_NUMBER, _YEAR = r"(?U)^\d+$", r"^(1[5-9]|20)\d\d$"


def rule_tags(toks: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Adds ``ner`` where no model does: numbers, amounts before a currency sign, years, and words of a gazetteer (text, label)."""
    by = Window.partitionBy("doc_id", "sent").orderBy("tok")
    number, after = F.col("text").rlike(_NUMBER), F.lead("text").over(by)
    tag = F.when(number & after.isin(*CURRENCY), "S-MONEY").when(F.col("text").rlike(_YEAR), "S-DATE").when(number, "S-CARDINAL").otherwise("O")
    out = toks.withColumn("ner", tag)
    if gazetteer is not None:
        known = gazetteer.select(F.col("text").alias("_t"), F.col("label").alias("_l")).dropDuplicates(["_t"])
        out = out.join(known, F.col("text") == F.col("_t"), "left")
        out = out.withColumn("ner", F.when(F.col("_l").isNotNull() & (F.col("ner") == "O"), F.concat(F.lit("S-"), "_l")).otherwise(F.col("ner"))).drop("_t", "_l")
    return out


def _valued(seen: segment.Seen) -> segment.Seen:
    seen = segment.where(seen, ~seen["blank"])
    money = seen["number"] & segment.beside(seen["sign"], seen["run"], 1)
    return seen | {"money": money, "quantity": np.zeros_like(money)}


def numbers_rule() -> segment.Rule:
    """What ``rule_tags`` sees of neighbours, as a rule of ``segment.tokens``, whose documents are one sentence; white space goes, ``number_tag`` makes tags of the ``money`` that it adds."""
    return segment.Rule(_valued, {"number": lambda text, tok: text.rlike(_NUMBER), "sign": lambda text, tok: text.isin(*CURRENCY)}, {"money": T.BooleanType()})


def number_tag(text: Column, money: Column) -> Column:
    """The tag after ``numbers_rule``, that of ``rule_tags`` without a gazetteer."""
    return F.when(money, "S-MONEY").when(text.rlike(_YEAR), "S-DATE").when(text.rlike(_NUMBER), "S-CARDINAL").otherwise("O")


#: Tags of the sentences of a batch: for each token ner, pos, dep and head_id, the head's place in the sentence from 1 or 0.
Model = Callable[[list[list[str]]], list[list[tuple[str, str, str, int]]]]


@functools.cache
def _loaded(load: Callable[[], Model]) -> Model:
    return load()


def batch_tagger(load: Callable[[], Model], sentences: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A tagger of tokens by a model, which each Python worker loads once.

    ``load`` is a function of a module, so that workers know it again.  Sentences stream
    past, sorted, and go to the model ``sentences`` at a time.
    """
    tags = [("ner", pa.string()), ("pos", pa.string()), ("dep", pa.string()), ("head_id", pa.int32())]

    def tagged(toks: DataFrame) -> DataFrame:
        names = [c for c in toks.columns if c not in dict(tags)]
        fields = [f for f in toks.schema.fields if f.name in names]
        schema = T.StructType([*fields, *(T.StructField(n, T.IntegerType() if n == "head_id" else T.StringType()) for n, _ in tags)])

        def told(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
            words = table.column("text").to_pylist()
            found = [t for s in _loaded(load)([words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]) for t in s]
            columns = [pa.array([t[k] for t in found], kind) for k, (_, kind) in enumerate(tags)]
            for (name, _), column in zip(tags, columns, strict=True):
                table = table.append_column(name, column)
            yield from table.to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None
            for batch in batches:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
                keys = list(zip(held.column("doc_id").to_pylist(), held.column("sent").to_pylist(), strict=True))
                ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]  # the last sentence may go on
                while len(ends) >= sentences:
                    cut = ends[sentences - 1]
                    yield from told(held.slice(0, cut), ends[:sentences])
                    held, ends = held.slice(cut), [e - cut for e in ends[sentences:]]
            if held is not None and held.num_rows:
                keys = list(zip(held.column("doc_id").to_pylist(), held.column("sent").to_pylist(), strict=True))
                yield from told(held, [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)])

        return toks.select(*names).repartition("doc_id", "sent").sortWithinPartitions("doc_id", "sent", "tok").mapInArrow(run, schema)

    return tagged
