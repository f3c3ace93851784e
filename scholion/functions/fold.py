"""Accent-free and case-free forms, without Python on the executors but for ``restored``."""

from __future__ import annotations

import bisect
import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _base(c: str, form: str) -> str:
    return "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))


@functools.cache
def _tables(form: str) -> tuple[str, str, dict[str, str]]:
    """Characters with a one-letter base, these bases, and the few that expand."""
    one, base, more = [], [], {}
    for code in range(0xA0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code < 0xE000 or unicodedata.combining(c):
            continue
        b = _base(c, form)
        if b != c and len(b) == 1:
            one.append(c), base.append(b)
        elif b != c and len(b) > 1 and (code < 0x2200 or 0xFB00 <= code <= 0xFB06):
            more[c] = b
    return "".join(one), "".join(base), more


#: Marks that stand by themselves behind their letter.
_COMBINING = r"\p{M}+"


def strip_accents(c: Column) -> Column:
    """Compatibility form without marks: ``ᾧ`` is ``ω``, ``ﬁ`` is ``fi``.  Expands characters below U+2200 and Latin ligatures only."""
    one, base, more = _tables("NFKD")
    out = F.translate(F.regexp_replace(c, _COMBINING, ""), one, base)
    rare = out
    for x, b in more.items():
        if len(b) <= 3:
            rare = F.replace(rare, F.lit(x), F.lit(b))
    return F.when(out.rlike("[" + "".join(x for x, b in more.items() if len(b) <= 3) + "]"), rare).otherwise(out)


def fold(c: Column) -> Column:
    """For comparison: no accents, lower case, one sigma, no blanks or dots around."""
    one, base, _ = _tables("NFD")
    plain = F.lower(F.translate(F.regexp_replace(c, _COMBINING, ""), one, base))
    return F.regexp_replace(F.replace(plain, F.lit("ς"), F.lit("σ")), "^[ .]+|[ .]+$", "")


def fold_text(s: str) -> str:
    """``fold`` of a literal."""
    return _base(s, "NFD").lower().replace("ς", "σ").strip(" .")


def folded_index(c: Column) -> Column:
    """struct(folded, idx): the folded text and, for each of its characters, its place in ``c``."""
    one, base, _ = _tables("NFD")
    each = F.filter(F.transform(F.split(c, ""), lambda x, i: F.struct(F.replace(F.lower(F.translate(F.regexp_replace(x, _COMBINING, ""), one, base)), F.lit("ς"), F.lit("σ")).alias("f"), i.alias("i"))), lambda x: x["f"] != "")
    return F.struct(F.array_join(F.transform(each, lambda x: x["f"]), "").alias("folded"), F.transform(each, lambda x: x["i"]).alias("idx"))


def find_loosely(needle: Column, region: Column) -> Column:
    """1-based place and length of ``needle`` in ``region``, with any blanks between its letters; null if absent.

    Case does not count.  Blanks of the needle don't count either.
    """
    letters = F.filter(F.split(F.replace(needle, F.lit(" "), F.lit("")), ""), lambda x: x != "")
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(letters, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), r"(?U:\s*)"))
    found = F.regexp_substr(region, pattern)
    return F.when((F.size(letters) > 0) & found.isNotNull(), F.struct(F.instr(region, found).alias("at"), F.length(found).alias("length")))


def restored_words(source: str, words: list[str], spare: int = 2) -> list[tuple[str, int | None, int | None]]:
    """Each word as ``source`` writes it, with its place [start, stop), for taggers that give words back without case or marks.

    Words are found in turn.  Between two found ones the source may have anything
    that is no letter or digit, ``spare`` letters or digits, and as many as the
    words have that were not found there; so one unknown word leads none astray.
    A word that isn't found is returned as it is, without a place.
    """
    plain = [_base(c, "NFD").lower().replace("ς", "σ") for c in source]
    place = [i for i, c in enumerate(plain) for _ in c]
    folded = "".join(plain)
    seen = [0]  # letters and digits before each place
    for c in folded:
        seen.append(seen[-1] + c.isalnum())
    out, done, missed = [], 0, 0
    for word in words:
        wanted = "".join(_base(c, "NFD") for c in word).lower().replace("ς", "σ")
        last = bisect.bisect_right(seen, seen[done] + spare + missed) - 1
        at = folded.find(wanted, done, last + len(wanted)) if wanted else -1
        if at < 0:
            out.append((word, None, None))
            missed += sum(map(str.isalnum, word))
            continue
        done, missed = at + len(wanted), 0
        start, stop = place[at], place[done - 1] + 1
        while stop < len(source) and unicodedata.combining(source[stop]):
            stop += 1
        out.append((source[start:stop], start, stop))
    return out


def restored(source: Column, words: Column) -> Column:
    """array<struct(text, start, stop)>: ``restored_words`` of a text and an array of words; null where either is null."""

    @F.pandas_udf("array<struct<text:string,start:int,stop:int>>")
    def run(text: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or w is None else [dict(zip(("text", "start", "stop"), x, strict=True)) for x in restored_words(t, [y or "" for y in w])] for t, w in zip(text, many, strict=True)])

    return run(source, words)
