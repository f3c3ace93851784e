"""Tag repair as windows over a sentence's tokens: no scan, one sort; numbers also as a rule on texts' tokens, without one.

Tokens are (doc_id, sent, tok, text, start, stop, ner).  Tags are ``O`` or a prefix of
B, I, E, S and a label.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from scholion.functions.fold import fold, fold_text
from scholion.operators.segment import beside, Rule, Seen

# Abbreviations that are no initials, and words after which a letter is one.
NO_INITIALS = sorted({fold_text(w) for w in ("γρ", "παρ", "σοῦμα")})
ARTICLES = sorted(
    {fold_text(w) for w in ("ο", "του", "τον", "τω", "η", "της", "την", "οι", "των", "τους", "δια", "απο", "υπο", "κ", "κα", "κος", "κύριος", "κύριον", "κυρίου")}
)


def _by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def merge_numbers(toks: DataFrame, keys: list[str] | None = None, order: str = "tok") -> DataFrame:
    """Retags digits joined by dots or commas without spaces, ``1.234.567``, as one number.

    It is MONEY if any of its tokens was, else QUANTITY if any was, else CARDINAL.
    """
    by = _by(keys or ["doc_id", "sent"], order)
    at = lambda k, c: F.lead(c, k).over(by)
    link = (
        F.col("text").rlike(r"(?U)^\d{1,3}$") & at(1, "text").isin(".", ",") & at(2, "text").rlike(r"(?U)^\d{3}$")
        & (at(1, "start") == F.col("stop")) & (at(2, "start") == at(1, "stop"))
    )
    out = toks.withColumn("_l", F.coalesce(link, F.lit(False)))
    back = lambda k: F.coalesce(F.lag("_l", k).over(by), F.lit(False))
    part = F.when(back(1) | F.col("_l") & back(2), "I").when(F.col("_l"), "B").when(back(2), "E")
    out = out.withColumn("_p", part)
    out = out.withColumn("_n", F.sum(F.when(F.col("_p") == "B", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy(*(keys or ["doc_id", "sent"]), "_n")
    kept = F.when(F.col("_p").isNotNull(), F.when(F.col("ner").contains("MONEY"), 2).when(F.col("ner").contains("QUANTITY"), 1).otherwise(0))
    best = F.max(kept).over(group)
    label = F.when(best == 2, "MONEY").when(best == 1, "QUANTITY").otherwise("CARDINAL")
    return out.withColumn("ner", F.when(F.col("_p").isNotNull(), F.concat_ws("-", "_p", label)).otherwise(F.col("ner"))).drop("_l", "_p", "_n")


def _parts(seen: Seen) -> Seen:
    run, start, stop = (seen[k] for k in ("run", "start", "stop"))
    link = seen["few"] & beside(seen["point"], run, 1) & beside(seen["three"], run, 2) & (beside(start, run, 1) == stop) & (beside(start, run, 2) == beside(stop, run, 1))
    back, two = beside(link, run, -1), beside(link, run, -2)
    part = np.where(back | link & two, 2, np.where(link, 1, np.where(two, 3, 0)))
    group = ((run != np.append(run[:1], run[:-1])) | (part == 1)).cumsum()
    best = np.zeros(int(group.max(initial=0)) + 1, np.int64)
    on = part > 0
    np.maximum.at(best, group[on], np.where(seen["money"], 2, np.where(seen["quantity"], 1, 0))[on])
    return seen | {"part": np.where(on, part + 4 * best[group], 0)}


def numbers_rule(ner: Callable[[Column, Column], Column] | None = None) -> Rule:
    """``merge_numbers`` as a rule of ``segment.tokens``, whose documents are one sentence; ``merged`` makes tags of the ``part`` that it adds.

    ``ner`` gives a token's tag so far by its text and ``tok``; without it a rule before tells ``money`` and ``quantity``.
    """
    tests = {"few": lambda text, tok: text.rlike(r"(?U)^\d{1,3}$"), "three": lambda text, tok: text.rlike(r"(?U)^\d{3}$"), "point": lambda text, tok: text.isin(".", ",")}
    if ner is not None:
        tests |= {k.lower(): lambda text, tok, k=k: ner(text, tok).contains(k) for k in ("MONEY", "QUANTITY")}
    return Rule(_parts, tests, {"part": T.IntegerType()})


def merged(part: Column, ner: Column) -> Column:
    """The tag after ``numbers_rule``."""
    place, best = part.bitwiseAND(3), F.shiftright(part, 2)
    label = F.when(best == 2, "MONEY").when(best == 1, "QUANTITY").otherwise("CARDINAL")
    return F.when(place == 0, ner).otherwise(F.concat(F.when(place == 1, "B-").when(place == 2, "I-").otherwise("E-"), label))


def _is(tag: Column, *labels: str) -> Column:
    return F.coalesce(F.regexp_replace(tag, "^[BIES]-", "").isin(*labels), F.lit(False))


def merge_initials(toks: DataFrame, keys: list[str] | None = None, order: str = "tok") -> DataFrame:
    """Joins an initial, its period and the name after it under one PER or GPE.

    A short word and the name must have the same label; a single letter may have
    none, after an article or title, before a person.
    """
    by = _by(keys or ["doc_id", "sent"], order)
    out = toks.withColumn("_f", fold(F.col("text")))
    last, word = F.lead("ner", 2).over(by), F.col("_f")
    able = (F.lead("text").over(by) == ".") & ~word.isin(NO_INITIALS) & ~F.lead("_f", 2).over(by).isin(NO_INITIALS)
    short = word.rlike(r"^\p{L}{1,4}$")
    led = F.coalesce(F.lag("_f").over(by).isin(ARTICLES), F.lit(False))
    person = _is(last, "PER", "PERSON") & (short & _is(F.col("ner"), "PER", "PERSON") | word.rlike(r"^\p{L}$") & led)
    place = short & _is(F.col("ner"), "GPE") & _is(last, "GPE")
    out = out.withColumn("_c", F.when(able & person, "PER").when(able & place, "GPE"))
    one, two = F.lag("_c", 1).over(by), F.lag("_c", 2).over(by)
    prefix, own = F.substring("ner", 1, 2), F.col("_c")
    head = F.concat(F.when(two.isNotNull() | prefix.isin("I-", "E-"), "I-").otherwise("B-"), own)
    tail = F.when(prefix == "S-", F.concat(F.lit("E-"), two)).when(prefix == "B-", F.concat(F.lit("I-"), two)).otherwise(F.col("ner"))
    tag = F.when(one.isNotNull(), F.concat(F.lit("I-"), one)).when(own.isNotNull(), head).when(two.isNotNull(), tail).otherwise(F.col("ner"))
    return out.withColumn("ner", tag).drop("_f", "_c")


def repair(toks: DataFrame) -> DataFrame:
    """Numbers first, then initials."""
    return merge_initials(merge_numbers(toks))
