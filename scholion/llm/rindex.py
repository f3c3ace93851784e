"""Exact long repeats by run-length indexes of the places where texts meet.

Every window of ``window`` bytes belongs to its minimizer: the gram in it whose
hash is least.  Equal windows have equal minimizers, so only windows of the same
minimizer can be equal, and the run of windows that a minimizer owns in a text
(its segment) is the unit of work:

1. segments are counted, pre-aggregated by hash; one that occurs twice is a
   repeat as a whole, however often it occurs, and leaves one representative;
2. where a minimizer has different segments, their representatives are indexed:
   a run-compressed Burrows-Wheeler transform with the suffixes at both ends of
   its runs and their common prefixes, from which the matching statistics of
   every other position follow while streaming over the text;
3. minimizers with more bytes of representatives than ``GROUP``, as groups of
   near copies have, are counted by window: hashes of a group are held up to
   ``HELD`` bytes of segments and only runs of repeated windows leave the task;
   beyond that the hashes themselves go on, spread over all tasks.

Matches of a share of the window, ``NOTICED``, are too short to be removed, but
are noticed: grams that are least within so many bytes are counted as well.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, byte_buffer, map_arrow, materialize, sliding_least, splitmix

WINDOW = 400
#: Share of the window that a gram has.
GRAM = 0.32
#: Bytes hashed at once; a longer text goes in parts, whose segments may differ but not its repeats.
BLOCK = 1 << 20
#: Bytes of segments in one index, and of one minimizer's segments that are gathered.
INDEX = 1 << 19
GROUP = 1 << 21
#: Bytes of one minimizer's segments whose window hashes a task holds.
HELD = 1 << 24
#: Share of the window that a match has which never goes unnoticed.
NOTICED = 0.6
_BASE = 0x9E3779B97F4A7C55 | 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""

    def up(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
        return out

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


_VALUE = splitmix(np.arange(256, dtype=np.uint64))


class Hashes:
    """Hashes of any ranges of a block of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = (p[: len(data) + 1] for p in _powers(BLOCK + (1 << 16)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


class Minimizers:
    """The least grams of the texts data[offsets[i]:offsets[i + 1]]."""

    _PLACE = np.uint64((1 << 21) - 1)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gram: int) -> None:
        self.gram, self.offsets = gram, offsets
        self.hashes = Hashes(data)
        at = np.arange(max(0, len(data) - gram + 1))
        self.own = splitmix(self.hashes(at, at + gram))
        self._ranked = (self.own & ~self._PLACE) | at.astype(np.uint64)
        self._text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def of(self, window: int) -> tuple[np.ndarray, ...]:
        """Runs of windows of one least gram: text, first window in the block, windows, place of the gram."""
        if len(self.own) < window - self.gram + 1:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        least = sliding_least(self._ranked, window - self.gram + 1) & self._PLACE
        start = np.flatnonzero(self.offsets[1:][self._text[: len(least)]] - np.arange(len(least)) >= window)
        least, text = least[start].astype(np.int64), self._text[start]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(start)), bool), (np.diff(least) != 0) | (np.diff(start) != 1) | (np.diff(text) != 0)]))
        return text[first], start[first], np.diff(np.append(first, len(start))), least[first]


def segments(data: np.ndarray, offsets: np.ndarray, window: int, noticed: int = 0) -> tuple[np.ndarray, ...]:
    """Of each segment: text, first window, windows, and the hashes of minimizer and segment.

    With ``noticed``, the grams that are least within so many bytes follow, with their places and no windows.
    """
    found = Minimizers(data, offsets, max(1, int(window * GRAM)))
    text, s1, n, least = found.of(window)
    whole = splitmix(found.hashes(s1, s1 + n - 1 + window)) ^ splitmix(n.astype(np.uint64) * np.uint64(1 << 20) + (least - s1).astype(np.uint64))
    out = text, s1 - offsets[text], n, found.own[least], whole
    if noticed:
        text, _, _, least = found.of(noticed)
        none = np.zeros(len(text), np.int64)
        more = text, least - offsets[text], none, found.own[least], none.view(np.uint64)
        out = tuple(np.concatenate(x) for x in zip(out, more, strict=True))
    return out


def _blocks(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, their offsets, rows and starts in the row, at most about BLOCK bytes each."""
    data, at = byte_buffer(texts)
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > BLOCK:
            for s in range(0, int(at[i + 1] - at[i]) - window + 1, BLOCK):
                a, b = at[i] + s, min(at[i] + s + BLOCK + window - 1, at[i + 1])
                yield data[a:b], np.array([0, b - a]), np.array([i]), np.array([s])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        yield data[at[i] : at[j]], at[i : j + 1] - at[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _occurrences(window: int, noticed: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for data, offsets, row, base in _blocks(batch.column(1), window):
            text, s1, n, gram, whole = segments(data, offsets, window, noticed)
            for col, x in zip(cols, (row[text], s1 + base[text], n, gram.view(np.int64), whole.view(np.int64)), strict=True):
                col.append(x)
        row, s1, n, gram, whole = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(s1, pa.int64()), pa.array(n, pa.int32()), pa.array(gram, pa.int64()), pa.array(whole, pa.int64())], ["key", "s1", "n", "gram", "whole"])

    return rows


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of some segments, with the suffixes at the ends of its runs."""

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + len(parts)
        text[ends] = np.arange(len(parts))  # each end is a letter of its own, so no match passes it
        self.size, self.starts = len(text), ends - sizes
        suffixes = self._sorted(text)
        last = text[suffixes - 1]
        at = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        #: The transform: a letter and a length for each run.
        self.letters, self.lengths = last[at], np.diff(np.append(at, len(last)))
        #: Suffixes where runs begin and end, and their common prefixes with the suffix before or after.
        self.heads, self.tails = suffixes[at], suffixes[np.append(at[1:], len(last)) - 1]
        between = self._common(text, self.tails[:-1], self.heads[1:])
        self.before, self.after = np.append(0, between), np.append(between, 0)

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        _, rank = np.unique(text, return_inverse=True)
        n, size = len(text), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = rank[size:] + 1
            pair = rank * (n + 2) + after
            order = np.argsort(pair)
            rank = np.empty(n, np.int64)
            new = np.append(False, np.diff(pair[order]) != 0)
            rank[order] = np.cumsum(new)
            if new.sum() == n - 1:
                return order
            size *= 2

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(text)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = (x < n) & (y < n)
            same[same] = text[x[same]] == text[y[same]]
            live = live[same]
            out[live] += 1
        return out

    def _streamed(self, sampled: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common prefixes at all positions: within a run one less with each step on."""
        reach, seen = np.zeros(self.size, np.int64), np.full(self.size, -1)
        reach[sampled], seen[sampled] = common + sampled, sampled
        seen = np.maximum.accumulate(seen)
        return np.where(seen >= 0, reach[np.maximum(seen, 0)] - np.arange(self.size), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match of what begins there with what begins elsewhere."""
        return np.maximum(self._streamed(self.heads, self.before), self._streamed(self.tails, self.after))


def _ranges(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _found(parts: list[tuple[int, int, bytes]], window: int) -> pa.RecordBatch:
    """Runs of windows that occur twice among segments (gram, whole, bytes)."""
    index = RunLengthIndex([p[2] for p in parts])
    repeated = index.matching_statistics() >= window
    row, start, stop = [], [], []
    for i, (s, p) in enumerate(zip(index.starts, parts, strict=True)):
        for a, b in zip(*_ranges(repeated[s : s + len(p[2])]), strict=True):
            row.append(i), start.append(a), stop.append(b)
    return _row([parts[i][0] for i in row], [parts[i][1] for i in row], start, stop, [None] * len(row))


def _row(gram, whole, start, stop, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(whole, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(h, pa.int64())], ["gram", "whole", "start", "stop", "h"])


def _hashes(part: bytes, window: int) -> np.ndarray:
    at = np.arange(len(part) - window + 1)
    return splitmix(Hashes(np.frombuffer(part, np.uint8))(at, at + window)).view(np.int64)


def _windows(gram: int, whole: int, h: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(h))
    return _row(np.full(len(h), gram), np.full(len(h), whole), at, at + 1, h)


def _counted(gram: int, wholes: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """Runs of windows that occur twice among the segments of a gram, by their hashes."""
    _, at, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    size = np.array([len(h) for h in hashes])
    # a gap after each segment, so that no run passes from one to the next
    on = np.insert(times[at] > 1, np.cumsum(size)[:-1], False)
    base = np.cumsum(size + 1) - size - 1
    start, stop = _ranges(on)
    own = np.searchsorted(base, start, side="right") - 1
    return _row(np.full(len(own), gram), np.array(wholes, np.int64)[own], start - base[own], stop - base[own], [None] * len(own))


def _indexed(window: int, group_bytes: int, held_bytes: int):
    """Segments sorted by gram to runs of repeated windows, or for groups beyond ``held_bytes`` to window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list = []  # segments of whole groups
        group: list = []  # of the last gram
        hashes: list = []  # of its windows, if it is large
        held = size = 0
        beyond = None  # a gram whose hashes go on

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, ready
            if hashes:
                yield _counted(group[0][0], [g[1] for g in group], hashes)
            elif len(group) > 1:
                ready += group
                held += size
            if held >= INDEX:
                yield _found(ready, window)
                ready, held = [], 0

        for batch in batches:
            for gram, whole, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram == beyond:
                    yield _windows(gram, whole, _hashes(part, window))
                    continue
                if group and group[0][0] != gram:
                    yield from closed()
                    group, hashes, size = [], [], 0
                size += len(part)
                if size <= group_bytes:
                    group.append((gram, whole, part))
                    continue
                if not hashes:
                    hashes = [_hashes(g[2], window) for g in group]
                group.append((gram, whole, b""))
                hashes.append(_hashes(part, window))
                if size > held_bytes:
                    beyond = gram
                    for g, h in zip(group, hashes, strict=True):
                        yield _windows(g[0], g[1], h)
                    group, hashes, size = [], [], 0
        yield from closed()
        if ready:
            yield _found(ready, window)

    return run


def _longest(places: list[int] | None, gram: int, gap: int) -> int:
    """The longest run of bytes under grams that follow within ``gap``."""
    if not places:
        return 0
    at = np.unique(np.array(places, np.int64))
    edge = np.flatnonzero(np.diff(at) > gap)
    return int((at[np.append(edge, len(at) - 1)] - at[np.append(0, edge + 1)]).max()) + gram


def _cut(window: int, noticed: int):
    gram = max(1, int(window * GRAM))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, spans, kept, longest = [], [], [], []
        for text, marks, places in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            text = text or b""
            size.append(len(text)), longest.append(_longest(places, gram, noticed - gram + 1))
            if not marks:
                spans.append([]), kept.append(text)
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, [m["start"] for m in marks], 1)
            np.add.at(edge, [m["stop"] - 1 + window for m in marks], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(*_ranges(gone), strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(longest, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "longest_run"])

    return rows


def long_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, noticed: int | None = None, group_bytes: int = GROUP, held_bytes: int = HELD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, longest_run) for every row.

    ``spans`` are the maximal runs [start, end) of bytes covered by a string of
    ``window`` bytes that also begins elsewhere, in the same text or another;
    ``kept`` is the rest.  All are judged on the input.  Null texts are empty.
    Rows that repeat, id and all, are texts of their own and remove each other.
    ``longest_run``: bytes of the longest run under sampled strings, of ``GRAM`` of the
    window each, that also occur elsewhere; a match of ``noticed`` bytes or more,
    ``NOTICED`` of the window if not given, has at least one.
    ``group_bytes`` and ``held_bytes`` choose among ways of equal results.
    Only the id and text columns are read; an empty table gives an empty result.
    """
    noticed = max(int(window * NOTICED), int(window * GRAM) + 1) if noticed is None else noticed
    if not max(1, int(window * GRAM)) <= noticed <= window:
        raise ValueError("noticed must exceed a sampled string and not the window")
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
    where = "key binary, s1 bigint, n int, gram bigint, whole bigint"
    every = materialize(map_arrow(source.select("key", "text"), _occurrences(window, noticed), where), "segments")
    seen, grams = every.where("n > 0"), every.where("n = 0").select("key", "gram", "s1")
    by_whole = seen.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("times"))
    by_whole = materialize(by_whole, "counts")
    by_gram = by_whole.groupBy("gram").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    state = by_whole.join(by_gram, "gram").select("gram", "whole", (F.col("times") > 1).alias("twice"), (F.col("kinds") > 1).alias("mixed"))
    met = materialize(seen.join(state, ["gram", "whole"]), "met")

    wanted = materialize(met.where("mixed").groupBy("key").agg(F.collect_set(F.struct("s1", "n", "gram", "whole")).alias("parts")), "wanted")
    parts = map_arrow(source.select("key", "text").join(wanted.hint("merge"), "key").select("text", "parts"), _extracted(window), "gram bigint, whole bigint, part binary")
    parts = parts.groupBy("gram", "whole").agg(F.first("part").alias("part"))
    found = parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_indexed(window, group_bytes, held_bytes), "gram bigint, whole bigint, start int, stop int, h bigint")
    found = materialize(found, "repeats")
    hashed = found.where("h is not null")
    again = hashed.groupBy("gram", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    runs = found.where("h is null").drop("h").unionByName(hashed.join(again, ["gram", "h"]).drop("h"))
    runs = runs.groupBy("gram", "whole").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))

    some = met.where("mixed and not twice").join(runs, ["gram", "whole"]).select("key", F.explode(F.transform("runs", lambda r: F.struct((F.col("s1") + r["start"]).alias("start"), (F.col("s1") + r["stop"]).alias("stop")))).alias("m"))
    whole = met.where("twice").select("key", F.struct(F.col("s1").alias("start"), (F.col("s1") + F.col("n")).alias("stop")).alias("m"))
    often = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram"), "often")
    shared = grams.join(often.hint("merge"), "gram").select("key", F.lit(None).cast("struct<start:bigint,stop:bigint>").alias("m"), F.col("s1").alias("place"))
    marks = whole.unionByName(some).withColumn("place", F.lit(None).cast("bigint")).unionByName(shared)
    marks = materialize(marks.groupBy("key").agg(F.collect_set("m").alias("marks"), F.collect_set("place").alias("places")), "marks")
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(source.join(marks.hint("merge"), "key", "left").select("doc_id", "text", "marks", "places"), _cut(window, noticed), f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, longest_run bigint")


def _extracted(window: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, whole, part = [], [], []
        for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for p in parts:
                gram.append(p["gram"]), whole.append(p["whole"]), part.append(text[p["s1"] : p["s1"] + p["n"] - 1 + window])
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(whole, pa.int64()), pa.array(part, pa.binary())], ["gram", "whole", "part"])

    return rows
