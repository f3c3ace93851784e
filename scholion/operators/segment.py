"""Tokens with true offsets, sentence and paragraph numbers, and bounded chunks.

One covering regular expression cuts a text; offsets are running lengths.  A text
has many times more bytes as rows of tokens than as itself, and a row costs more
than the rules on it: where tokens come from texts, rules that look at neighbours
(``Rule``) read them while a document is one row, so that tokens are neither sorted
nor shuffled.  For tables of tokens the same rules are windows keyed by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

TOKEN = r"(?Us)\s+|\w+|."
#: Abbreviations whose period doesn't end a sentence.
ABBREVIATIONS = [
    ",", "υπ'", "υπ", "γ.ε.μη", "αφμ", "α.φ.μ.", "α.φ.μ", "λ", "γ", "ρ", "ν", "τ", "Κ", "Μ", "Η", "Τ,Κ", "κιν", "τηλ", "αρ", "παρ", "παρ.",
    "αυξ", "αύξ", "αύξ.", "αυξ.", "αρίθ", "αρθρ", "αρθ", "άρθ", "αριθ", "αριθ.", "αριθμ", "αριθμ.", "πρωτ", "α.ε", "κα",
]
#: Ends of sentences where no model says more.
STOPS = [".", "!", "?", ";", "·", "…"]
#: Tokens that rules see at once, but for longer documents.
BLOCK = 1 << 17


#: What rules know of consecutive whole documents' tokens: arrays ``run`` (the document), ``tok``, ``start``, ``stop``, ``at`` (place among all) and those of tests and rules.
Seen = dict[str, np.ndarray]


@dataclass
class Rule:
    """A rule on neighbouring tokens, and the columns that it adds.

    ``tests`` are functions of a token's text and ``tok``, which Spark computes; null
    fails.  ``work`` may add arrays to what it is given, and drop tokens (``where``).
    """

    work: Callable[[Seen], Seen]
    tests: dict[str, Callable[[Column, Column], Column]]
    added: dict[str, T.DataType]


def where(seen: Seen, on: np.ndarray) -> Seen:
    """What is known of the tokens that are ``on``."""
    return {k: x[on] for k, x in seen.items()}


def beside(values: np.ndarray, run: np.ndarray, k: int) -> np.ndarray:
    """Each token's value ``k`` tokens on, or back if negative, in its document; zero where there is none."""
    out = np.zeros_like(values)
    n = len(values) - abs(k)
    if n > 0:
        here, there = (slice(0, n), slice(k, None)) if k > 0 else (slice(-k, None), slice(0, n))
        out[here] = np.where(run[here] == run[there], values[there], 0)
    return out


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = ()) -> DataFrame:
    """(doc_id, tok, text, start, stop, blank) and what ``rules`` add: everything in the text, white space too.

    Rules work one after the other on what those before have left.  Ids are taken to
    be unique: windows over rows of one id would mix their tokens.
    """
    tests = {"blank": lambda text, tok: text.rlike(r"(?U)^\s")} | {k: test for rule in rules for k, test in rule.tests.items()}
    if len(tests) > 32:
        raise ValueError("a token has at most 32 tests")
    order, works = list(tests), [rule.work for rule in rules]
    code = lambda text, tok: sum((F.when(test(text, tok), F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests.values())), F.lit(0).cast("bigint"))
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    cut = dealt.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("words"))
    cut = cut.select("doc_id", "words", F.transform("words", F.length).alias("sizes"), F.transform("words", code).alias("codes"))
    number = T.IntegerType()
    kinds = {"tok": number, "start": number, "stop": number, "blank": T.BooleanType()} | {k: kind for rule in rules for k, kind in rule.added.items()}
    names = list(kinds)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        edge = batch.column(1).offsets.to_numpy().astype(np.int64)
        size = np.diff(edge)
        lengths, codes = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
        run, first = np.repeat(np.arange(len(size)), size), edge[:-1] - edge[0]
        stop = lengths.cumsum()
        stop -= (stop - lengths)[first[run]]
        at = np.arange(len(run))
        seen = {"run": run, "at": at, "tok": at - first[run], "start": stop - lengths, "stop": stop} | {k: codes >> i & 1 == 1 for i, k in enumerate(order)}
        for work in works:
            seen = work(seen)
        ids, text = batch.column(0).take(pa.array(seen["run"])), batch.column(1).flatten()
        text = text if len(seen["at"]) == len(at) else text.take(pa.array(seen["at"]))
        own = [pa.array(seen[k] if seen[k].dtype == bool else seen[k].astype(np.int32)) for k in names]
        return pa.RecordBatch.from_arrays([ids, own[0], text, *own[1:]], ["doc_id", "tok", "text", *names[1:]])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, end = 0, batch.column(1).offsets.to_numpy()
            while done < batch.num_rows:
                upto = max(done + 1, int(np.searchsorted(end, end[done] + BLOCK, "right")) - 1)
                out, done = some(batch[done:upto]), upto
                yield from (out[k : k + BLOCK] for k in range(0, out.num_rows, BLOCK))

    fields = [cut.schema["doc_id"], T.StructField("tok", number), T.StructField("text", T.StringType()), *(T.StructField(k, kinds[k]) for k in names[1:])]
    return cut.mapInArrow(told, T.StructType(fields))


def _abbreviation(text: Column, suffix: bool) -> Column:
    low = F.lower(text)
    if not suffix:
        return low.isin([a.lower() for a in ABBREVIATIONS])
    held = low.isin([])
    for a in ABBREVIATIONS:
        held = held | low.endswith(a)
    return held


def sentence_starts(toks: DataFrame, suffix: bool = False) -> DataFrame:
    """Adds ``starts``: whether a token begins a sentence.

    A token after a full stop and white space begins one, unless an abbreviation,
    slash or hyphen forbids it; a blank line always ends a sentence, and white
    space never begins one.  ``suffix``: an abbreviation may be a word's ending.
    """
    # single spaces are no tokens to the rules: they are passed over
    plain = F.col("text") == " "
    by = Window.partitionBy("doc_id", plain).orderBy("tok")
    last = F.lead("text", 2).over(by).isNotNull()
    after = F.lead("text").over(by)
    spaced = F.lead("start").over(by) > F.col("stop")
    binds = last & (_abbreviation(F.col("text"), suffix) & ((after == ".") | spaced & F.lit(suffix)) | after.isin("/", "-"))
    out = toks.withColumn("_b", F.coalesce(binds, F.lit(False)))
    held = F.col("_b") | F.coalesce(F.lag("_b", 1).over(by), F.lit(False)) | F.coalesce(F.lag("_b", 2).over(by), F.lit(False))
    held = held | last & F.trim("text").isin(".", ",")
    line_feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    prev_blank = F.coalesce(F.lag("blank").over(by), F.lit(False))
    broken = prev_blank & (F.lag(line_feeds).over(by) >= 2)
    ended = F.when(prev_blank, F.lag("text", 2).over(by)).when(F.lag("stop").over(by) < F.col("start"), F.lag("text").over(by))
    starts = F.when(F.col("tok") == 0, True).when(F.col("blank"), False).when(broken, True).when(held, False).otherwise(F.coalesce(ended.isin(STOPS), F.lit(False)))
    return out.withColumn("starts", starts).drop("_b")


def _begins(seen: Seen, suffix: bool) -> Seen:
    at = np.flatnonzero(~seen["space"])  # single spaces are passed over
    on = where(seen, at)
    run, start, stop, blank, full = (on[k] for k in ("run", "start", "stop", "blank", "full"))
    any_ = np.ones(len(at), bool)
    last = beside(any_, run, 2)
    spaced = beside(any_, run, 1) & (beside(start, run, 1) > stop)
    binds = last & (on["abbreviation"] & (beside(on["period"], run, 1) | spaced & suffix) | beside(on["joins"], run, 1))
    held = binds | beside(binds, run, -1) | beside(binds, run, -2) | last & on["mark"]
    prev_blank = beside(blank, run, -1)
    broken = prev_blank & beside(on["feeds"], run, -1)
    apart = beside(any_, run, -1) & (beside(stop, run, -1) < start)
    ended = np.where(prev_blank, beside(full, run, -2), apart & beside(full, run, -1))
    starts = seen["tok"] == 0
    starts[at] |= ~blank & (broken | ~held & ended)
    return seen | {"starts": starts}


def _feeds(text: Column, tok: Column | None = None) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= 2


def starts_rule(suffix: bool = False) -> Rule:
    """``sentence_starts`` as a rule of ``tokens``."""
    tests = {
        "space": lambda text, tok: text == " ",
        "feeds": _feeds,
        "abbreviation": lambda text, tok: _abbreviation(text, suffix),
        "period": lambda text, tok: text == ".",
        "joins": lambda text, tok: text.isin("/", "-"),
        "mark": lambda text, tok: F.trim(text).isin(".", ","),
        "full": lambda text, tok: text.isin(STOPS),
    }
    return Rule(lambda seen: _begins(seen, suffix), tests, {"starts": T.BooleanType()})


def _numbered(seen: Seen) -> Seen:
    run, starts = seen["run"], seen["starts"]
    new = np.append(True, run[1:] != run[:-1]) if len(run) else starts
    first = np.flatnonzero(new)[new.cumsum() - 1]

    def count(x: np.ndarray) -> np.ndarray:
        so_far = x.cumsum()
        return so_far - (so_far - x)[first]

    begins = new | starts
    para = count(seen["blank"] & seen["feeds"])[begins][begins.cumsum() - 1]
    return seen | {"sent": count(starts) - 1, "para": para}


def sentences_rule() -> Rule:
    """``sentences`` as a rule of ``tokens``, after ``starts_rule``."""
    return Rule(_numbered, {"feeds": _feeds}, {"sent": T.IntegerType(), "para": T.IntegerType()})


def sentences(starts: DataFrame) -> DataFrame:
    """Adds ``sent`` and ``para``, both from 0; a paragraph ends at a blank line."""
    past = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    breaks = F.sum(F.when(F.col("blank") & (feeds >= 2), 1).otherwise(0)).over(past)
    out = starts.withColumn("sent", (F.sum(F.col("starts").cast("int")).over(past) - 1).cast("int")).withColumn("_p", breaks.cast("int"))
    first = Window.partitionBy("doc_id", "sent").orderBy("tok")
    return out.withColumn("para", F.first("_p").over(first)).drop("_p")


def sentence_table(toks: DataFrame) -> DataFrame:
    """(doc_id, sent, para, start, stop, text) of the tokens with ``sent`` and ``para``; white space around them is cut."""
    inner = toks.where(~F.col("blank"))
    span = inner.groupBy("doc_id", "sent").agg(F.min("para").alias("para"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    words = toks.join(span, ["doc_id", "sent"]).where(F.col("tok").between(F.col("lo"), F.col("hi")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "text"))), lambda t: t["text"]), "")
    return words.groupBy("doc_id", "sent").agg(F.first(span["para"]).alias("para"), F.first(span["start"]).alias("start"), F.first(span["stop"]).alias("stop"), text.alias("text"))


def subwords(text: Column) -> Column:
    """A stand-in for a tokenizer: four letters are a piece."""
    return F.ceil(F.length(text) / 4).cast("int")


def chunks(toks: DataFrame, measure: Callable[[Column], Column] = subwords, limit: int = 508, soft: int = 350, spare: int = 15) -> DataFrame:
    """Adds ``chunk``: sentences of more than ``limit`` pieces are cut after ``, ; :`` beyond ``soft`` pieces, or before a token that would pass the limit less ``spare``.

    ``measure`` gives a token's pieces, by functions of columns or an Arrow UDF.  Only
    long sentences are read one token after the other; they stream past, sorted.
    """
    names = toks.columns
    sized = toks.withColumn("_n", F.when(F.col("blank"), 0).otherwise(measure(F.col("text"))).cast("bigint"))
    sized = sized.withColumn("_all", F.sum("_n").over(Window.partitionBy("doc_id", "sent")))
    short = sized.where(F.col("_all") <= limit).select(*names, F.lit(0).alias("chunk"))
    long = sized.where(F.col("_all") > limit).drop("_all").repartition("doc_id", "sent").sortWithinPartitions("doc_id", "sent", "tok")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, held = None, 0, 0
        for batch in batches:
            out = []
            for doc, sent, text, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sent", "text", "_n")), strict=True):
                if (doc, sent) != key:
                    key, now, held = (doc, sent), 0, 0
                if held > soft and text in {",", ";", ":"}:
                    out.append(now)
                    now, held = now + 1, 0
                    continue
                if held and held + size > limit - spare:
                    now, held = now + 1, 0
                out.append(now)
                held += size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int32())], [*names, "chunk"])

    return short.unionByName(long.mapInArrow(numbered, T.StructType([*toks.schema.fields, T.StructField("chunk", T.IntegerType())])))
