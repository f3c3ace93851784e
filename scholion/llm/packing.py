"""Packing by cutting-stock column generation.

Texts are cut at multiples of the sequence length; what is left of each is an
item.  Items stay whole, unless they fit together so badly (many a little longer
than half a sequence, say) that all must be cut at a half, a quarter and so on.  Item lengths make a histogram of at most ``CLASSES`` classes.  A linear
program over patterns (how many items of each class share a sequence) is solved
by column generation, its columns priced by a knapsack dynamic program.  Rounded
down patterns and a best fit of the few items that rounding leaves make a plan,
whose size depends on the classes and never on the corpus.  Items are ranked
within their class and find pattern, sequence and place from their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholion.llm.common import as_bytes, map_arrow, materialize
from scholion.llm.tokens import encoder

LENGTH = 2048
#: Tokens by which a class is wide; items count as the longest of their class.
WIDTH = 8
END = 1
#: Parts of a class that are ranked apart.
SALTS = 256
#: The linear program may be this much above its bound.
GAP = 5e-4
ROUNDS = 6000
#: Share of padding above which items are cut too.
PADDING = 0.02
#: Share of the best bound's prices in those that columns are priced by.
SMOOTH = 0.85


def price(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value that fits, and how many of each size."""
    order = np.argsort(sizes, kind="stable")
    size, worth = sizes[order], value[order]
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if n := fits[w]:
            got = best[w - size[:n]] + worth[:n]
            k = int(got.argmax())
            if got[k] > best[w] + 1e-12:
                best[w], took[w] = got[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[order[took[w]]] += 1
            w -= int(size[took[w]])
    return float(best[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often, close to the linear program's optimum.

    Prices are smoothed towards those of the best lower bound so far, which
    keeps the columns from swinging; a column that the simplex's own prices
    don't want is priced again by those.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (room // sizes))
    x = (inverse * demand).sum(axis=1)
    calm, bound = sizes / room, float(demand @ sizes) / room
    for i in range(ROUNDS):
        own = inverse.sum(axis=0)
        if x.sum() - bound <= max(GAP * bound, 0.5):
            break
        for share in (SMOOTH, 0.0):
            prices = np.maximum(share * calm + (1 - share) * own, 0)
            best, column = price(sizes, prices, room)
            if (low := float(demand @ prices) / best) > bound:
                calm, bound = prices / best, low
            if own @ column > 1 + 1e-9:
                break
        else:
            break
        step = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        patterns[out] = column
        x -= ratio[out] * step
        x[out] = ratio[out]
        inverse[out] /= step[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        if i % 300 == 299:  # rounding errors don't pile up
            off = 2 * np.eye(m) - np.einsum("ij,jk->ik", patterns.T.astype(float), inverse)
            inverse = np.einsum("ij,jk->ik", inverse, off)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    return patterns, np.maximum(x, 0)


def best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for few items, the longest first, each where it leaves the least room."""
    bins: list[tuple[int, dict[int, int]]] = []
    by_room: dict[int, list[int]] = {}
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[k])):
            size = int(sizes[k])
            at = next((r for r in range(size, room + 1) if by_room.get(r)), None)
            if at is None:
                b, at = len(bins), room
                bins.append((room, {}))
            else:
                b = by_room[at].pop()
            own = bins[b][1]
            own[int(k)] = own.get(int(k), 0) + 1
            bins[b] = (at - size, own)
            by_room.setdefault(at - size, []).append(b)
    return [(own, 1) for _, own in bins]


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """(items of each class by its place in ``sizes``, sequences): all items, none twice."""
    if not len(sizes):
        return []
    patterns, x = solve(sizes, demand.astype(float), room)
    whole = np.floor(x + 1e-9).astype(np.int64)
    left, out = demand.astype(np.int64).copy(), []
    for p in np.argsort(-whole, kind="stable"):
        on = np.flatnonzero(patterns[p])
        n = int(min([whole[p], *(left[on] // patterns[p][on])]))
        if n > 0:
            out.append(({int(k): int(patterns[p][k]) for k in on}, n))
            left[on] -= n * patterns[p][on]
    return out + best_fit(sizes, left, room)


def shorter(sizes: np.ndarray, demand: np.ndarray, steps: list[tuple[dict[int, int], int]], room: int) -> int:
    """The longest halving of ``room`` at which items must be cut for little padding; 0 if they fit together as they are."""

    def padded(demand: np.ndarray, sizes: np.ndarray, steps) -> bool:
        return sum(n for _, n in steps) > -(-int(demand @ sizes) // room) * (1 + PADDING) + 1

    whole, least = (demand, sizes), room
    while len(sizes) and padded(*whole, steps) and least > room >> 5:
        least //= 2
        count: dict[int, int] = {}
        for s, n in zip(sizes.tolist(), demand.tolist(), strict=True):
            for size, k in ((least, s // least), (s % least, 1)) if s < room else ((s, 1),):
                if size and k:
                    count[size] = count.get(size, 0) + n * k
        cut = np.array(sorted(count.items()), np.int64)
        whole = cut[:, 1], cut[:, 0]
        steps = plan(cut[:, 0], cut[:, 1], room)
    return least if least < room else 0


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, cut: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each text's ids and the end id, cut at multiples of ``length``, and the rest at multiples of ``cut``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, row, cols = encoder(tokenizer), [], ([], [], [], [])
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode((text or b"").decode("utf-8", "replace")), np.array([end], "<u4")).astype("<u4")
            data = memoryview(ids.tobytes())
            whole = len(ids) // length * length
            for at in (*range(0, whole, length), *range(whole, len(ids), cut)):
                part = data[4 * at : 4 * (at + (length if at < whole else cut))]
                row.append(i)
                for col, v in zip(cols, (at, len(part) // 4, zlib.crc32(part), len(ids)), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_arrow(source, rows, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _places(classes: np.ndarray, steps: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class, of each step that uses it: the first rank, the items a sequence and the first sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    done, sequence = {}, 0
    for own, n in steps:
        for k, a in own.items():
            c = int(classes[k])
            out.setdefault(c, []).append((done.get(c, 0), a, sequence))
            done[c] = done.get(c, 0) + a * n
        sequence += n
    return {c: tuple(np.array(col, np.int64) for col in zip(*rows, strict=True)) for c, rows in out.items()}


def _assign(shared, names: list[str]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("cls", "rank"))
        sequence = np.empty(len(cls), np.int64)
        for c in np.unique(cls):
            first, a, base = shared.value[int(c)]
            on = cls == c
            k = np.searchsorted(first, rank[on], side="right") - 1
            sequence[on] = base[k] + (rank[on] - first[k]) // a[k]
        keep = [i for i, n in enumerate(names) if n not in ("cls", "rank")]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence)], [*(names[i] for i in keep), "sequence_id"])

    return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A null or empty text is its end token alone.  Repeated rows are packed each
    for itself; equal lengths are ranked by id and start.  Only the id and text
    columns are read.  An empty table makes no sequence.
    """
    def ranks(pieces: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Pieces of each class that come before a salt's, and how many there are of each class."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = pieces.groupBy("cls", "salt").agg(F.count(F.lit(1)).alias("n"))
        counted = materialize(counted.select("cls", "salt", "n", before.alias("before")), "ranks")
        rows = sorted((r["cls"], r["n"]) for r in counted.groupBy("cls").agg(F.sum("n").alias("n")).collect())
        classes, demand = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 2
        return counted, classes, demand

    def made(cut: int) -> DataFrame:
        found = pieces(docs, tokenizer, id_col, text_col, length, end, cut)
        salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")
        return materialize(found.withColumn("cls", F.ceil(F.col("length") / width).cast("int")).withColumn("salt", salt), "pieces")

    room = -(-length // width)
    cut = made(length)
    before, classes, demand = ranks(cut)
    steps = plan(classes, demand, room)
    if finer := shorter(classes, demand, steps, room):
        cut = made(finer * width)
        before, classes, demand = ranks(cut)
        steps = plan(classes, demand, room)
    shared = docs.sparkSession.sparkContext.broadcast(_places(classes, steps))
    own = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(F.broadcast(before.drop("n")), ["cls", "salt"])  # at most SALTS rows a class
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("before") + F.col("own")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    placed = map_arrow(ranked, _assign(shared, ranked.columns), f"{kinds}, sequence_id bigint")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
