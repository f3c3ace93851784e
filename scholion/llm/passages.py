"""Near-duplicate passages by compact windows.

Under a min-hash, the windows of a text whose least token is the same make a
compact window, a node of the Cartesian tree over the token hashes.  Windows of one
length are compared, ``WINDOW`` tokens: the nodes that hold one are the places that
are least of some such window, so sliding minima list them without the tree.  Tokens are shingles of five words.

For each of ``HASHES`` min-hashes, equal least tokens bring compact windows of
different texts together.  Of a pair of texts, each such meeting is a rectangle
of window starts; where rectangles of ``ENOUGH`` hashes overlap are candidates,
all of them, and the shingle sets of the two windows decide.

Up to ``CELL`` compact windows of one token are all paired.  More of them, a crowd, are
compared without pairs (``crowd_links``): equal windows are one, windows with too many
tokens that no other text there has are out, and the others meet the most frequent
ones first; what one of those has linked need not be compared again, except
between texts that are still apart.  A crowd loses no link, so that two texts with near
windows that share a crowd's token need no further hash in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, map_arrow, materialize, sliding_least, splitmix
from scholion.llm.graph import components
from scholion.llm.simhash import shingle_hashes

WORDS = 5
#: Tokens of a window: passages of 50 words.
WINDOW = 46
HASHES = 6
ENOUGH = 3
SIMILARITY = 0.8
CELL = 12
#: Tokens hashed at once, a million at most.
BLOCK = 1 << 18
ROW = ["least", "key", "place"]
MET = ["a", "b", "at_a", "at_b", "least"]
BOX = ["a", "b", "from_a", "to_a", "from_b", "to_b"]
FOUND = ["a", "b", "starts_a", "starts_b"]
#: Pairs of windows of a crowd that are compared at once.
PAIRS = 1 << 18
#: Bytes of tokens that leave a task at once.
PIECE = 1 << 22
#: Window starts of one text that are compared at once with as many of another.
TILE = 64


def compact_windows(parts: list[np.ndarray], window: int, hashes: int) -> Iterator[tuple[int, np.ndarray, ...]]:
    """For each hash: the part, the first window start, further starts, place of the least token after the first and its value, of each compact window."""
    size = np.array([len(p) for p in parts])
    token, part = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
    base = np.cumsum(size) - size
    if len(token) < window:
        return
    ok = np.flatnonzero(part[: len(token) - window + 1] == part[window - 1 :])
    if not len(ok):
        return
    place = np.uint64((1 << 21) - 1)
    at = np.arange(len(token), dtype=np.uint64)
    for j in range(hashes):
        value = splitmix(token ^ splitmix(np.uint64([j + 1])))
        least = (sliding_least((value & ~place) | at, window) & place).astype(np.int64)[ok]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(ok) != 1)]))
        more = np.diff(np.append(first, len(ok))) - 1
        own = part[ok[first]]
        yield j, own, ok[first] - base[own], more, least[first] - ok[first], value[least[first]]


def _windows(words: int, window: int, hashes: int):
    """Texts, each once in a task, to (least, key, place): first start, place of the least token, further starts and hash in one number."""

    def made(parts: list[np.ndarray], keys: list[int], starts: list[int]) -> Iterator[pa.RecordBatch]:
        keys, starts = np.array(keys, np.int64), np.array(starts, np.int64)
        for j, own, s, more, at, value in compact_windows(parts, window, hashes):
            place = (s + starts[own]) << 24 | at << 16 | more << 8 | j
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(keys[own]), pa.array(place)], ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, keys, starts, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                token = shingle_hashes(text, words)
                for s in range(0, len(token) - window + 1, BLOCK):
                    parts.append(token[s : s + BLOCK + window - 1]), keys.append(key), starts.append(s)
                    held += len(parts[-1])
                    if held >= BLOCK:
                        yield from made(parts, keys, starts)
                        parts, keys, starts, held = [], [], [], 0
        if parts:
            yield from made(parts, keys, starts)

    return run


def _meetings(batches: Iterator[pa.RecordBatch], cell: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (least, key, place) to (a, b, at_a, at_b) of texts that share a least token; of a crowd's texts to (key, null, first start, last start, least)."""

    def pairs(least: np.ndarray, key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = [np.empty(0, np.int64)]
        for step in range(1, min(cell, len(least))):
            on = np.flatnonzero(least[step:] == least[:-step])
            if not len(on):
                break
            x.append(on[key[on] != key[on + step]] << 16 | step)
        x = np.concatenate(x)
        if len(x):
            x, y = x >> 16, (x >> 16) + (x & 0xFFFF)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (key[x], key[y], place[x], place[y])), pa.nulls(len(x), pa.int64())], MET)

    def crowds(least: np.ndarray, key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = place >> 24
        end = start + (place >> 8 & 255)
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (key[1:] != key[:-1]) | (start[1:] != end[:-1] + 1)]))
        if len(least):
            to = np.append(new[1:], len(least)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.nulls(len(new), pa.int64()), pa.array(start[new]), pa.array(end[to]), pa.array(least[new])], MET)

    rest, large = [np.empty(0, np.int64)] * 3, False
    for batch in batches:
        rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(rest, batch.columns, strict=True)]
        fresh = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in rows]))
        ran = rows[0][0] if large else None
        fresh[0] = not large  # a crowd's last row is only here to be compared with
        if not fresh.any() or not len(rows[0]):
            continue
        rows = [x[fresh] for x in rows]
        least = rows[0]
        start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        size = np.diff(np.append(start, len(least)))
        big = size > cell
        big[0] |= ran is not None and least[0] == ran
        many = np.repeat(big, size)
        large = bool(big[-1])
        cut = len(least) if large else start[-1]
        yield from crowds(*(x[many] for x in rows))
        yield from pairs(*(x[:cut][~many[:cut]] for x in rows))
        rest = [x[-1:] for x in rows] if large else [x[cut:] for x in rows]
    if not large:
        yield from pairs(*rest)


def overlaps(at_a: np.ndarray, at_b: np.ndarray, enough: int) -> list[tuple[int, int, int, int]]:
    """Boxes (first and last start in a, the same in b) around all window starts that lie in rectangles of enough hashes.

    Rectangles count wherever they overlap, whatever their alignment.  A box is
    the part of a tile of ``TILE`` starts of both texts that has such starts.
    """
    a0, b0, j = at_a >> 24, at_b >> 24, at_a & 255
    a1, b1 = a0 + (at_a >> 8 & 255), b0 + (at_b >> 8 & 255)
    parts = []
    for da in range(int((a1 // TILE - a0 // TILE).max()) + 1):
        for db in range(int((b1 // TILE - b0 // TILE).max()) + 1):
            ta, tb = a0 // TILE + da, b0 // TILE + db
            on = np.flatnonzero((ta <= a1 // TILE) & (tb <= b1 // TILE))
            parts.append((ta[on], tb[on], on))
    ta, tb, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((tb, ta))
    ta, tb, row = ta[order], tb[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])]))
    out: list[tuple[int, int, int, int]] = []
    for s, e in zip(start.tolist(), np.append(start[1:], len(row)).tolist(), strict=True):
        if e - s < enough:
            continue
        mine = row[s:e]
        kinds, kind = np.unique(j[mine], return_inverse=True)
        if len(kinds) < enough:
            continue
        x, y = int(ta[s]) * TILE, int(tb[s]) * TILE
        held = np.zeros((len(kinds), TILE, TILE), bool)
        for k, p, q, u, v in zip(kind, a0[mine] - x, a1[mine] - x, b0[mine] - y, b1[mine] - y, strict=True):
            held[k, max(p, 0) : q + 1, max(u, 0) : v + 1] = True
        good = held.sum(axis=0) >= enough
        if good.any():
            p, u = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
            out.append((x + int(p[0]), x + int(p[-1]), y + int(u[0]), y + int(u[-1])))
    return out


def _candidates(enough: int):
    """Meetings sorted by (a, b) to (a, b, from_a, to_a, from_b, to_b); rows of crowds to (key, null, first start, last start, least, null)."""

    def found(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        a, b, at_a, at_b = rows
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(start, len(a)))
        out = []
        for s, n in zip(start[size >= enough], size[size >= enough], strict=True):
            if len(np.unique(at_a[s : s + n] & 255)) >= enough:
                out += [(a[s], b[s], *box) for box in overlaps(at_a[s : s + n], at_b[s : s + n], enough)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], BOX) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.column(1).null_count:
                alone = batch.filter(batch.column(1).is_null())
                yield pa.RecordBatch.from_arrays([alone.column(k) for k in (0, 1, 2, 3, 4, 1)], BOX)
                batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(4)]
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
            edge = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
            cut = edge[-1] + 1 if len(edge) else 0
            if cut and (out := found([x[:cut] for x in now])) is not None:
                yield out
            rest = [x[cut:] for x in now]
        if rest and len(rest[0]) and (out := found(rest)) is not None:
            yield out

    return run


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = [len((text or b"").split()) for text in batch.column(2).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "key", "n_words"])


def _passages(words: int, window: int):
    """(key, text, ranges), sorted by key, to the tokens of each range, of a text once."""

    def batch_of(*cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["key", "start", "end", "least", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, out = None, 0, ([], [], [], [], [])
        for batch in batches:
            for k, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == before:
                    continue
                before = k
                token = (shingle_hashes(text, words) >> np.uint64(32)).astype(np.uint32)
                for r in ranges:
                    row = k, r["start"], r["end"], r["least"], token[r["start"] : r["end"] + window].tobytes()
                    held += len(row[-1])
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                    if held >= PIECE:
                        yield batch_of(*out)
                        held, out = 0, ([], [], [], [], [])
        if out[0]:
            yield batch_of(*out)

    return run


def alike(x: np.ndarray, y: np.ndarray, window: int, similarity: float) -> np.ndarray:
    """For each window start in x and each in y, whether the sets of tokens are alike."""
    values, place = np.unique(np.concatenate([x, y]), return_inverse=True)

    def held(at: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(at) + 1, len(values)), np.int32)
        seen[np.arange(1, len(at) + 1), at] = 1
        seen = seen.cumsum(axis=0, dtype=np.int32)
        return (seen[window:] > seen[:-window]).astype(np.float32)

    p, q = held(place[: len(x)]), held(place[len(x) :])
    both = (p @ q.T).astype(np.float64)
    return both >= similarity * (p.sum(axis=1, dtype=np.float64)[:, None] + q.sum(axis=1, dtype=np.float64) - both)


def _thin(starts: np.ndarray, window: int) -> list[int]:
    """Of runs of consecutive starts the ends, and so many between that windows touch."""
    if starts[-1] - starts[0] == len(starts) - 1:
        return [*range(int(starts[0]), int(starts[-1]), window), int(starts[-1])]
    edge = np.flatnonzero(np.diff(starts) != 1)
    out: list[int] = []
    for s, e in zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist(), strict=True):
        out += [*range(s, e, window), e]
    return out


def _alike(window: int, similarity: float):
    """Boxes with their tokens to (a, b, starts_a, starts_b) of those that have windows alike."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b, from_a, from_b = (batch.column(k).to_pylist() for k in range(4))
        out = []
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            good = alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), window, similarity)
            if good.any():
                starts = (np.flatnonzero(good.any(axis=k)) + s for k, s in ((1, from_a[i]), (0, from_b[i])))
                out.append((a[i], b[i], *(_thin(s, window) for s in starts)))
        if not out:
            return None
        one, many = pa.int64(), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (one, one, many, many), strict=True)], FOUND)

    return rows


def crowd_links(key: np.ndarray, start: np.ndarray, tokens: list[bytes], window: int, similarity: float) -> tuple[list[int], list[int], list[list[int]]]:
    """(a, b, starts_a) that link the texts of a crowd as comparing all its windows would, and the starts of a that are alike with another text's.

    Linear in the crowd: a text has one row, with another of its class.  No pair of windows is left
    out but such as cannot be alike, or whose texts are linked and whose windows both have a partner.
    """
    texts, text = np.unique(key, return_inverse=True)
    if len(texts) < 2:
        return [], [], []
    # equal passages are one
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(x, len(known)) for x in tokens])
    weight, lo, hi = np.bincount(kind), np.full(len(known), len(texts)), np.full(len(known), -1)
    np.minimum.at(lo, kind, text), np.maximum.at(hi, kind, text)
    parts = [np.frombuffer(x, np.uint32) for x in known]
    size = np.array([len(x) for x in parts])
    base, own = np.cumsum(size) - size, np.repeat(np.arange(len(parts)), size)
    values, ids = np.unique(np.concatenate(parts), return_inverse=True)
    none = len(values)
    first, last = np.full(none + 1, len(texts)), np.full(none + 1, -1)
    np.minimum.at(first, ids, lo[own]), np.maximum.at(last, ids, hi[own])
    alone = first == last  # tokens of one text; a window with many of them is like no other text's
    once_ = np.zeros(len(ids), bool)
    once_[np.unique(own * (none + 1) + ids, return_index=True)[1]] = True
    lost = np.append(0, np.cumsum(once_ & alone[ids]))
    at = np.flatnonzero(own[: len(own) - window + 1] == own[window - 1 :])
    # sets of n and m tokens are alike from this share of n + m in common on; m is ``floor`` at least
    share = similarity / (1 + similarity)
    floor = window if once_.all() else 1
    at = at[lost[at + window] - lost[at] <= window - np.maximum(share * (window + floor), similarity * window) + 1e-6]
    sets, marks = [], []
    mixed = np.append(splitmix(np.arange(none, dtype=np.uint64)), np.uint64(0))
    for block in np.split(at, range(1 << 15, len(at), 1 << 15)):
        rows = np.sort(ids[block[:, None] + np.arange(window)].astype(np.int32), axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
        sets.append(rows), marks.append(mixed[rows].sum(axis=1))
    _, pick, node = np.unique(np.concatenate(marks), return_index=True, return_inverse=True)
    rows, count = np.concatenate(sets)[pick], len(pick)
    least, most = np.full(count, len(texts)), np.full(count, -1)
    np.minimum.at(least, node, lo[own[at]]), np.maximum.at(most, node, hi[own[at]])
    sizes = (rows < none).sum(axis=1)
    left, before = np.ones(count, bool), -1
    while left.any() and left.sum() != before:
        before, floor = left.sum(), sizes[left].min()
        need = np.maximum(share * (sizes + floor), similarity * sizes) - 1e-6
        first[:], last[:] = len(texts), -1
        np.minimum.at(first, rows[left], least[left, None]), np.maximum.at(last, rows[left], most[left, None])
        alone = first == last
        alone[none] = False
        left &= sizes - alone[rows].sum(axis=1) >= need
    if not left.any():
        return [], [], []
    on = left[node]
    place, node = at[on], (np.cumsum(left) - 1)[node[on]]
    rows, sizes, need, least, most = rows[left], sizes[left], need[left], least[left], most[left]
    of, count = own[place], len(rows)
    times, several = np.bincount(node, weight[of]), least < most

    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def union(x: np.ndarray, y: np.ndarray) -> None:
        for code in np.unique(x * len(texts) + y).tolist():
            u, v = find(code // len(texts)), find(code % len(texts))
            root[max(u, v)] = min(u, v)

    here = np.zeros(len(parts), bool)
    here[of] = True
    union(text[here[kind]], lo[kind][here[kind]]), union(lo[of], least[node])
    covered = several.copy()
    if not covered.all() or len({find(t) for t in np.unique(least).tolist()}) > 1:
        # windows alike have one of their rarest tokens in common, of so many that the others are too few
        rank = np.full(none + 1, none)
        rank[np.lexsort((np.bincount(ids[once_], minlength=none), ~alone[:none]))] = np.arange(none)
        rows, lonely = np.sort(rank[rows], axis=1), np.append(np.sort(alone[:none])[::-1], True)
        most_rare = int((sizes - np.ceil(need)).max()) + 1
        rare = rows[:, :most_rare]
        rare = np.where((np.arange(rare.shape[1]) <= (sizes - np.ceil(need))[:, None]) & ~lonely[rare], rare, none)
        flat = np.flatnonzero(rare.ravel() < none)
        flat = flat[np.argsort(rare.ravel()[flat], kind="stable")]
        listed = flat // rare.shape[1]
        many = np.bincount(rare.ravel()[flat], minlength=none + 1)
        begins = np.cumsum(many) - many
        load = many[rare].sum(axis=1)
        # each token turns one of 128 bits, so that sets differ in no fewer tokens than bits
        bit = splitmix(np.arange(none, dtype=np.uint64)) & np.uint64(127)
        bits = [np.append(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), np.uint64(0)) for k in range(2)]
        bits = [np.bitwise_xor.reduce(b[rows], axis=1) for b in bits]
        settled = np.zeros(count, bool)

        def meet(xs: np.ndarray) -> np.ndarray:
            """All windows alike with one of ``xs`` and not of its one text."""
            held = np.zeros((len(xs), none + 1), bool)
            held[np.arange(len(xs))[:, None], rows[xs]] = True
            held[:, none] = False
            x, token = np.repeat(np.arange(len(xs)), rare.shape[1]), rare[xs].ravel()
            n = many[token]
            x, y = np.repeat(x, n), listed[np.repeat(begins[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            apart = np.bitwise_count(bits[0][xs][x] ^ bits[0][y]) + np.bitwise_count(bits[1][xs][x] ^ bits[1][y])
            on = np.flatnonzero(apart <= (1 - 2 * share) * (sizes[xs][x] + sizes[y]) + 1e-6)
            x, y = x[on], y[on]
            on = several[xs[x]] | several[y] | (least[xs[x]] != least[y])
            x, y = x[on], y[on]
            near = [np.empty(0, bool)]
            for i in range(0, len(x), 1 << 16):
                u, v = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                both = held[u[:, None], rows[v]].sum(axis=1)
                near.append(both >= similarity * (sizes[xs[u]] + sizes[v] - both))
            near = np.concatenate(near)
            x, y = xs[x[near]], y[near]
            covered[x] = covered[y] = True
            union(least[x], least[y])
            return y

        def batches(open_: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
            """The windows that are open, the most frequent first, in batches that grow."""
            rest, step = np.argsort(-times, kind="stable"), 1
            while len(rest := rest[open_(rest)]):
                fit = int(np.searchsorted(np.cumsum(load[rest[:step]]), PAIRS, "right"))
                fit = max(1, min(fit, step, (1 << 24) // (none + 1)))
                yield rest[:fit]
                rest, step = rest[fit:], 2 * step

        met = np.zeros(count, bool)
        for xs in batches(lambda rest: ~settled[rest] & ~covered.all()):
            settled[meet(xs)] = True
            met[xs] = settled[xs] = True
        # windows of different classes, neither of which has met all
        classes = np.array([find(t) for t in least[covered].tolist()])
        if len(classes) and (classes != classes[0]).any():
            main = int(np.bincount(classes).argmax())
            open_ = lambda rest: ~met[rest] & (np.array([find(t) for t in least[rest].tolist()]) != find(main))
            for xs in batches(open_):
                meet(xs)

    on = covered[node]
    of, shift = of[on], (place - base[own[place]])[on]
    member = np.argsort(kind, kind="stable")
    begin, n = (np.cumsum(weight) - weight)[of], weight[of]
    row = member[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    whose, starts = text[row], start[row] + np.repeat(shift, n)
    sort = np.lexsort((starts, whose))
    whose, starts = whose[sort], starts[sort]
    new = np.append(True, (whose[1:] != whose[:-1]) | (starts[1:] != starts[:-1])) if len(whose) else np.empty(0, bool)
    whose, starts = whose[new], starts[new]
    edge = np.flatnonzero(np.append(True, whose[1:] != whose[:-1])) if len(whose) else []
    a, b, out, other = [], [], [], {}
    for mine, part in zip(whose[edge].tolist(), np.split(starts, edge[1:]), strict=True) if len(whose) else ():
        if (r := find(mine)) != mine:
            other[r] = mine
        a.append(mine), b.append(r), out.append(_thin(part, window))
    b = [other[y] if x == y else y for x, y in zip(a, b, strict=True)]
    return texts[np.array(a, np.int64)].tolist(), texts[np.array(b, np.int64)].tolist(), out


def _crowds(window: int, similarity: float):
    """(least, key, start, tokens) sorted by least to rows as of ``_alike``, crowd by crowd."""

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (1, 2))
        a, b, starts = crowd_links(key, start, [t for x in held for t in x.column(3).to_pylist()], window, similarity)
        for i in range(0, len(a), 1 << 14):
            part, many = slice(i, i + (1 << 14)), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a[part], pa.int64()), pa.array(b[part], pa.int64()), pa.array(starts[part], many), pa.array([[]] * len(a[part]), many)], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, token = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            least = batch.column(0).to_numpy()
            cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(least)], strict=True):
                if held and least[s] != token:
                    yield from links(held)
                    held = []
                token = least[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from links(held)

    return run


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, window: int = WINDOW, hashes: int = HASHES, enough: int = ENOUGH, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(doc_id, class_id, n_words, n_shared, spans) for every row.

    ``spans`` are the maximal runs [start, end) of words in passages that another
    text has nearly alike: windows of ``window`` shingles with a Jaccard similarity
    of ``similarity`` or more.  Copies of a text with a window share all of it.
    ``class_id`` is the smallest id that is reached by sharing passages, the
    row's own if there is none.  Texts too short for a window, and null ones,
    share nothing.  Rows equal in id and text are copies too.  Texts are told apart by
    a 64-bit hash.  Beyond ``cell`` windows of one least token they are compared as a crowd, in
    full and within one task, and not by pairs of texts.  Only the id and text columns are read.
    """
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 shingles")
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), as_bytes(text_col).alias("text"))
    rows = source.select("key", "text").mapInArrow(_windows(words, window, hashes), "least bigint, key bigint, place bigint")
    met = rows.repartition("least").sortWithinPartitions("least", "key", "place").mapInArrow(lambda it: _meetings(it, cell), ", ".join(f"{c} bigint" for c in MET))
    boxes = met.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_candidates(enough), ", ".join(f"{c} bigint" for c in BOX))
    boxes = materialize(boxes.distinct(), "candidates")
    near, crowd = boxes.where("b is not null"), boxes.where("b is null")
    ends = [near.select(F.col(k).alias("key"), F.struct(F.col(f"from_{k}").alias("start"), F.col(f"to_{k}").alias("end"), F.lit(None).cast("bigint").alias("least")).alias("r")) for k in "ab"]
    ends.append(crowd.select(F.col("a").alias("key"), F.struct(F.col("from_a").alias("start"), F.col("to_a").alias("end"), F.col("from_b").alias("least")).alias("r")))
    wanted = materialize(ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("key").agg(F.collect_set("r").alias("ranges")), "wanted")
    cut = source.join(wanted.hint("merge"), "key").select("key", "text", "ranges").mapInArrow(_passages(words, window), "key bigint, start bigint, end bigint, least bigint, tokens binary")
    cut = materialize(cut, "passages")
    passages = cut.where("least is null").groupBy("key", "start", "end").agg(F.first("tokens").alias("tokens"))
    left = passages.select(F.col("key").alias("a"), F.col("start").alias("from_a"), F.col("end").alias("to_a"), F.col("tokens").alias("x"))
    right = passages.select(F.col("key").alias("b"), F.col("start").alias("from_b"), F.col("end").alias("to_b"), F.col("tokens").alias("y"))
    both = near.join(left, ["a", "from_a", "to_a"]).join(right, ["b", "from_b", "to_b"]).select("a", "b", "from_a", "from_b", "x", "y")
    alikes = "a bigint, b bigint, starts_a array<bigint>, starts_b array<bigint>"
    crowds = cut.where("least is not null").select("least", "key", "start", "tokens").repartition("least").sortWithinPartitions("least", "key", "start").mapInArrow(_crowds(window, similarity), alikes)
    found = materialize(map_arrow(both, _alike(window, similarity), alikes).unionByName(crowds), "alike")
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))

    kind = docs.schema[id_col].dataType.simpleString()
    base = materialize(map_arrow(source, _counted, f"doc_id {kind}, key bigint, n_words bigint"), "texts")
    texts = base.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    full = window + words - 1
    own = found.select(F.col("a").alias("key"), F.explode("starts_a").alias("start")).unionByName(found.select(F.col("b").alias("key"), F.explode("starts_b").alias("start")))
    own = own.groupBy("key").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    shared = texts.join(own, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    shared = shared.withColumn("whole", (F.col("copies") > 1) & (F.col("n_words") >= full)).where("whole or root is not null")
    shared = materialize(shared.select("key", "whole", "starts", F.coalesce("root", "key").alias("root"), "least"), "shared")
    classes = shared.groupBy("root").agg(F.min("least").alias("class_id"))
    shared = shared.join(classes, "root").select("key", "whole", "starts", "class_id")
    # runs of windows that touch; the starts are sorted
    opens = F.filter(F.transform("starts", lambda s, i: F.when((i == 0) | (s > F.get("starts", i - 1) + full), s)), lambda s: s.isNotNull())
    closes = F.filter(F.transform("starts", lambda s, i: F.when(F.get("starts", i + 1).isNull() | (F.get("starts", i + 1) > s + full), s + full)), lambda s: s.isNotNull())
    runs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce(runs, none))
    out = base.join(shared, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_words", spans.alias("spans"))
    n_shared = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "class_id", "n_words", n_shared.alias("n_shared"), "spans")
