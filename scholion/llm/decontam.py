"""Benchmark decontamination: test n-grams in a hash set, training windows against it.

The n-grams are broadcast only in blocks of at most ``BLOCK`` rows.  A larger
benchmark has several blocks, which the documents pass one after the other
without any shuffle; the hits add up in columns that travel with the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, map_arrow, materialize

WINDOW = 13
BLOCK = 200_000
#: Blocks that one job scans for, each with Python workers of its own.
CHAIN = 3
#: Words of a window that are looked up first.
HEAD = 3

#: Bytes outside words become spaces, A-Z lower case; other words are [0-9a-z] and all that isn't ASCII.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def ngrams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, gram) of every window; an item of fewer words is one window, one of none has none.

    ``item`` is the id as text, empty for null.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        item, size, gram = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words_of(text)
            n = min(window, len(w))
            grams = {b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if w else ()
            item += [i] * len(grams)
            size += [n] * len(grams)
            gram += grams
        return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.binary())], ["item", "n", "gram"])

    source = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), as_bytes(text_col).alias("text"))
    return map_arrow(source, rows, "item string, n int, gram binary").distinct()


class Index:
    """A block's n-grams by length, and the heads by which most windows are dismissed."""

    def __init__(self, rows) -> None:
        self.grams: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for r in rows:
            self.grams.setdefault(r["n"], {}).setdefault(tuple(bytes(r["gram"]).split(b" ")), []).append(r["item"])
        self.heads = {n: {g[:n] for m, by in self.grams.items() for g in by if min(m, HEAD) == n} for n in {min(m, HEAD) for m in self.grams}}

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of windows that occur, and their items."""
        spans, items = [], set()
        for n, heads in self.heads.items():
            at = [i for i, h in enumerate(zip(*(w[k:] for k in range(n)), strict=False)) if h in heads]
            for m, by in self.grams.items():
                if at and min(m, HEAD) == n:
                    for i in at:
                        if found := by.get(tuple(w[i : i + m])):
                            spans.append((i, i + m))
                            items.update(found)
        return spans, items


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, *extra, n_words, n_hit, spans, items) for every row of ``docs``.

    ``spans`` are the maximal runs [start, end) of hit words and ``items`` the
    ids, sorted as text, of the benchmark items that occur.  Null and wordless
    texts have no words and no hits; an empty benchmark hits nothing; items that
    repeat an id count once.  Repeated rows repeat.  Only the named columns are
    read, whatever else there is.
    """
    spark = docs.sparkSession
    grams = materialize(ngrams(benchmark, item_col, item_text_col, window), "ngrams")
    blocks = max(1, -(-grams.count() // block))
    more = F.struct(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in (extra or {}).items()))
    state = docs.select(more.alias("more"), as_bytes(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("span"), F.array().cast("array<string>").alias("items"))
    schema = state.schema
    for k in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("item", "gram"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast(Index(part))
        state = map_arrow(state, _scan(index, last=k == blocks - 1), schema)
        if k % CHAIN == CHAIN - 1 and k < blocks - 1:
            state = materialize(state, "contamination")
    spans = F.transform(F.sequence(F.lit(0), F.size("span") - 2, F.lit(2)), lambda i: F.struct(F.get("span", i).alias("start"), F.get("span", i + 1).alias("end")))
    spans = F.when(F.size("span") > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    state = state.select("more", "n_words", spans.alias("spans"), "items")
    return state.select("more.*", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _scan(index, last: bool):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, span, items = [], [], []
        for text, old, had in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            w = words_of(text)
            found, named = index.value.hits(w)
            count.append(len(w))
            span.append([x for s in _united([*found, *zip(old[::2], old[1::2], strict=True)]) for x in s])
            items.append(sorted(named.union(had)))
        text = pa.nulls(len(count), pa.binary()) if last else batch.column(1)
        return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(count, pa.int64()), pa.array(span, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["more", "text", "n_words", "span", "items"])

    return rows


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
