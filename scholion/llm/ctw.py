"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words, joined by spaces, and an end byte.  Each byte is
eight binary decisions; each decision has a tree of contexts, the up to ``DEPTH``
bytes before, with Krichevsky-Trofimov estimates mixed over all depths by the
weights that the training data give them.

All bytes are counted, as grams of a context and its next byte.  Contexts that end
alike are weighted together where they are gathered, so no task holds more than
the contexts under three bytes, and the grams that lie there are scored on the
spot, from the deepest context up.  No node is left out: the tree is never in one
place, and only its nodes of contexts under ``GATHERED`` bytes, 255 for each of
those contexts however large the corpus, are sent to all tasks.

Texts are scored by their grams.  The grams seen most, ``CACHED`` at most, are known
to each task; the others meet their scores in an equi-join, so the border between
the two changes no score.  The base score is that of single words, and words are
held and joined in the same way, by ``WORDS``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, map_arrow, materialize, splitmix

DEPTH = 5
#: Contexts that end in the same so many bytes are weighted in one task.
GATHERED = 3
#: Grams and words whose scores and counts every task knows, and the longest of these words in bytes.
CACHED = 1 << 21
WORDS = 1 << 18
WORD_BYTES = 64
END = b"\n"
#: Bytes whose grams are counted at once.
BLOCK = 1 << 20
#: Distinct words, or grams, that a task holds before it passes them on, bytes of text from which it passes on words, and rows of a batch that it makes.
HELD = 1 << 19
HELD_BYTES = 1 << 27
ROWS = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts its ``depth`` predecessors and itself as one number, and the texts' lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    pad = END * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(data) - depth), np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - depth + k]
    starts = np.cumsum(size + depth) - size - depth
    real = np.ones(len(data), bool)
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return code[real[depth:]], size


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[list[bytes]], list[bytes]]]:
    """Rows, words and normal forms, in blocks."""
    row, words, form, held = [], [], [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        w = words_of(text)
        row.append(i), words.append(w), form.append(b" ".join(w) + END)
        held += len(form[-1])
        if held >= BLOCK:
            yield row, words, form
            row, words, form, held = [], [], [], 0
    if row:
        yield row, words, form


def _gathered(depth: int):
    """Texts (held_out, text) to (word, gram, n, met), counted as far as a task can hold them.

    ``n`` counts what is learnt from, ``met`` all texts.  Words are those learnt from.
    """

    def out(word: pa.Array, gram: pa.Array, n: pa.Array, met: pa.Array) -> Iterator[pa.RecordBatch]:
        batch = pa.RecordBatch.from_arrays([word, gram, n, met], ["word", "gram", "n", "met"])
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)

    def out_words(words: Counter) -> Iterator[pa.RecordBatch]:
        n = pa.array(words.values(), pa.int64())
        yield from out(pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), n, n)

    def out_grams(code: np.ndarray, n: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from out(pa.nulls(len(code), pa.binary()), pa.array(code.view(np.int64)), pa.array(n), pa.array(met))

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(code)).astype(np.int64) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, size = Counter(), [], 0
        for batch in batches:
            held_out = batch.column(0).to_pylist()
            for row, each, form in _texts(batch, 1):
                learnt = [not held_out[i] for i in row]
                for w, f, on in zip(each, form, learnt, strict=True):
                    if on:
                        words.update(w)
                        words[END] += 1
                        size += len(f)
                for on in (True, False):
                    own = [f for f, x in zip(form, learnt, strict=True) if x == on]
                    if own:
                        code, n = np.unique(grams(own, depth)[0], return_counts=True)
                        parts.append((code, n * on, n))
                if sum(len(p[0]) for p in parts) > 2 * HELD:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > HELD:
                        yield from out_grams(*parts.pop())
                if len(words) > HELD or size > HELD_BYTES:
                    yield from out_words(words)
                    words, size = Counter(), 0
        yield from out_words(words)
        yield from out_grams(*merged(parts))

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of x >= 0.5, by Stirling's series eight steps up."""
    less = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - less


@dataclass
class Nodes:
    """Of one depth: context and decision as one number, zeros and ones seen, log weighted probability, share of the own estimate."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    share: np.ndarray


def _block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)


def leaves(code: np.ndarray, n: np.ndarray) -> Nodes:
    """Of grams: the eight decisions of the last byte in the whole context."""
    context, byte = (code >> np.uint64(8)) << np.uint64(8), code & np.uint64(255)
    keys, on, count = [], [], []
    for k in range(8):
        keys.append(context | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        on.append((byte >> np.uint64(7 - k)) & np.uint64(1))
        count.append(n)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    on, count = np.concatenate(on).astype(bool), np.concatenate(count).astype(float)
    zeros, ones = np.bincount(at, count * ~on, len(key)), np.bincount(at, count * on, len(key))
    return Nodes(key, zeros, ones, _block_log(zeros, ones), np.ones(len(key)))


def shorter(nodes: Nodes, depth: int) -> Nodes:
    """The parents, ``depth`` bytes deep: half their own estimate, half their children's product."""
    key, at = np.unique(nodes.key & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    zeros, ones, below = (np.bincount(at, x, len(key)) for x in (nodes.zeros, nodes.ones, nodes.weighted))
    own = _block_log(zeros, ones)
    weighted = np.logaddexp(own, below) - math.log(2)
    return Nodes(key, zeros, ones, weighted, np.exp(own - math.log(2) - weighted))


def mixed(chance: np.ndarray, code: np.ndarray, nodes: Nodes, depth: int) -> None:
    """Takes the grams one depth up: ``chance``, of each decision that was made (NaN where no longer context is known), becomes that of the contexts of ``depth`` bytes."""
    if not len(nodes.key):
        return
    context, byte = (code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1), code & np.uint64(255)
    for k in range(8):
        key = (context << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        at = np.minimum(np.searchsorted(nodes.key, key), len(nodes.key) - 1)
        on = nodes.key[at] == key
        zeros, ones, share = nodes.zeros[at], nodes.ones[at], nodes.share[at]
        own = (np.where(_bit(byte, k), ones, zeros) + 0.5) / (zeros + ones + 1)
        longer = chance[k]
        chance[k] = np.where(on, np.where(np.isnan(longer), own, share * own + (1 - share) * longer), longer)


def _bit(code: np.ndarray, k: int) -> np.ndarray:
    """The k-th decision of the last byte."""
    return ((code >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)


NODE_NAMES = ["key", "zeros", "ones", "weighted", "share"]
_NODES = "key bigint, zeros double, ones double, weighted double, share double"
_DEEP = f"{_NODES}, met bigint, chance array<float>"


def _rows(x: Nodes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.key.view(np.int64)), *(pa.array(v, pa.float64()) for v in (x.zeros, x.ones, x.weighted, x.share))], NODE_NAMES)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut where it changes."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        edge = np.flatnonzero(np.diff(now[0]))
        cut = edge[-1] + 1 if len(edge) and len(now[0]) >= BLOCK >> 6 else 0
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest and len(rest[0]):
        yield rest


def _deep(depth: int, top: int):
    """Counted grams, sorted by where they end, to the nodes of ``top`` bytes and to the grams with their chances there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, n, met in _whole_groups(batches):
            code = code.view(np.uint64)
            chance = np.full((8, len(code)), np.nan)
            nodes = leaves(code[n > 0], n[n > 0])
            mixed(chance, code, nodes, depth)
            for d in range(depth - 1, top - 1, -1):
                nodes = shorter(nodes, d)
                mixed(chance, code, nodes, d)
            kept = _rows(nodes)
            none = [pa.nulls(kept.num_rows, pa.int64()), pa.nulls(kept.num_rows, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *none], [*NODE_NAMES, "met", "chance"])
            lists = _lists(chance.T.astype(np.float32).ravel(), np.full(len(code), 8))
            none = [pa.nulls(len(code), pa.float64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *none, pa.array(met), lists], [*NODE_NAMES, "met", "chance"])

    return run


def _lifted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, zeros, ones, weighted in _whole_groups(batches):
            yield _rows(shorter(Nodes(key.view(np.uint64), zeros, ones, weighted, weighted), depth))

    return run


def _nodes_of(df: DataFrame) -> Nodes:
    """Of contexts of few bytes, here."""
    got = df.select(*NODE_NAMES).sort("key").toArrow()
    key, *rest = (got.column(c).to_numpy() for c in NODE_NAMES)
    return Nodes(key.view(np.uint64), *rest)


@dataclass
class Model:
    """The nodes of contexts of up to ``depth`` bytes."""

    depth: int
    key: np.ndarray  # with the depth above the context
    one: np.ndarray  # estimate that the decision is 1; a last one more, of no node
    share: np.ndarray  # of that estimate, where a longer context is known
    table: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addresses: which node lies where, at half load at most."""
        if self.table is None:
            bits = max(4, len(self.key).bit_length() + 1)
            held = np.full(1 << bits, -1, np.int32)
            todo = np.arange(len(self.key), dtype=np.int32)
            at = (splitmix(self.key) >> np.uint64(64 - bits)).astype(np.int64)
            while len(todo):
                free = held[at[todo]] < 0
                held[at[todo[free]]] = todo[free]
                todo = todo[held[at[todo]] != todo]
                at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            self.table = held, np.append(self.key, ~np.uint64(0)), bits
        return self.table

    def find(self, key: np.ndarray) -> np.ndarray:
        """The node of each key, -1 if there is none."""
        held, keys, bits = self._table()
        at = (splitmix(key) >> np.uint64(64 - bits)).astype(np.int64)
        out = held[at]
        todo = np.flatnonzero((out >= 0) & (keys[out] != key))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            out[todo] = held[at[todo]]
            todo = todo[(out[todo] >= 0) & (keys[out[todo]] != key[todo])]
        return out

    def _own(self, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return np.where(bit, self.one[node], 1 - self.one[node])

    def log10(self, code: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Of each gram, the probability of its last byte after the others, ``chance`` being that of each decision by contexts longer than these."""
        head, back = np.unique(code & np.uint64((1 << 8 * (self.depth + 1)) - 1), return_inverse=True)  # many grams share their short contexts
        total = np.zeros(len(code))
        for k in range(8):
            first, bit = np.uint64(1 << k) | ((head & np.uint64(255)) >> np.uint64(8 - k)), _bit(head, k)
            node = self.find(first)
            # the probability so far is known + rest * (that of the longer contexts); a path that has ended has node -1
            known, rest = np.where(node >= 0, 0.0, 0.5), (node >= 0).astype(float)
            for d in range(1, self.depth + 1):
                context = (head >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
                child = self.find(np.uint64(d << 56) | (context << np.uint64(8)) | first)
                child = np.where(node >= 0, child, -1)
                share = np.where(child >= 0, self.share[node], 1.0)
                known += rest * share * self._own(node, bit)
                rest *= 1 - share
                node = child
            own, share = self._own(node, bit), self.share[node]
            ended, on, below = known + rest * own, known + rest * share * own, rest * (1 - share)
            total += np.log10(np.where(np.isnan(chance[k]), ended[back], on[back] + below[back] * chance[k]))
        return total


def _finished(shared):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = batch.column(0).to_numpy().view(np.uint64)
        chance = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8).T.astype(float)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared.value.log10(code, chance))], ["gram", "met", "score"])

    return rows


def gram_scores(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, met, score) of each of (gram, n, met): the log10 probability of the last byte after those before, by the whole tree of all grams that ``n`` counts."""
    spark = counted.sparkSession
    top = min(GATHERED, depth)
    last = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    dealt = counted.select(last.alias("last"), "gram", "n", "met").repartition("last").sortWithinPartitions("last")
    deep = materialize(dealt.mapInArrow(_deep(depth, top), _DEEP), "contexts")
    below, short = deep.where("met is null").select(*NODE_NAMES), []
    for d in range(top, 1, -1):
        last = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
        dealt = below.select(last.alias("last"), "key", "zeros", "ones", "weighted").repartition("last").sortWithinPartitions("last")
        below = materialize(dealt.mapInArrow(_lifted(d - 1), _NODES), "nodes")
        short.insert(0, _nodes_of(below))
    short.insert(0, shorter(short[0] if short else _nodes_of(below), 0))
    key = np.concatenate([x.key | np.uint64(d << 56) for d, x in enumerate(short)])
    one = np.concatenate([*((x.ones + 0.5) / (x.zeros + x.ones + 1) for x in short), [0.5]])
    share = np.concatenate([*(x.share for x in short), [1.0]])
    shared = spark.sparkContext.broadcast(Model(top - 1, key, one, share))
    found = map_arrow(deep.where("met is not null").select(F.col("key").alias("gram"), "met", "chance"), _finished(shared), "gram bigint, met bigint, score double")
    return materialize(found, "grams")


def _step(n: Column) -> Column:
    """How often, in steps of an eighth of a doubling."""
    return F.floor(8 * F.log2(n)).cast("int")


def _least_step(df: DataFrame, n: Column, most: int) -> int:
    """The least step of which, with all above, there are ``most`` rows at most."""
    sizes = sorted(((r["step"], r["count"]) for r in df.groupBy(_step(n).alias("step")).count().collect()), reverse=True)
    least = 1 << 30
    for s, k in sizes:
        if k > most:
            break
        least, most = s, most - k
    return least


class Scorer:
    """Scores blocks of texts by the grams that are known to it."""

    def __init__(self, code: np.ndarray, value: np.ndarray, depth: int) -> None:
        self.code, self.value, self.depth = code, value, depth

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """The sum of each text's known grams, its other grams, and how often each of these occurs in it."""
        code, size = grams(texts, self.depth)
        own, at = np.unique(code, return_inverse=True)
        value, known = np.zeros(len(own)), np.zeros(len(own), bool)
        if len(self.code):
            place = np.minimum(np.searchsorted(self.code, own), len(self.code) - 1)
            known = self.code[place] == own
            value[known] = self.value[place[known]]
        total = np.concatenate([[0.0], np.cumsum(value[at])])
        ends = np.cumsum(size)
        other = np.flatnonzero(~known[at])
        text = np.searchsorted(ends, other, side="right")
        pair, times = np.unique(text * max(1, len(own)) + at[other], return_counts=True)
        sizes = np.bincount(pair // max(1, len(own)), minlength=len(texts))
        return total[ends] - total[ends - size], _lists(own[pair % max(1, len(own))].view(np.int64), sizes), _lists(times.astype(np.int64), sizes)


def _scored(shared):
    """Texts to the scores of what each task knows, and the words and grams whose counts and scores are elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, often, unit, end = shared.value
        for batch in batches:
            for row, each, form in _texts(batch, 2):
                cols: tuple[list, ...] = ([], [], [], [], [])
                for w in each:
                    known, base, words, times = int(end > 0), math.log10((end + 0.5) / unit), [], []
                    for word, n in Counter(w).items():
                        if (c := often.get(word)) is not None:
                            known += n
                            base += n * math.log10((c + 0.5) / unit)
                        else:
                            words.append(word), times.append(n)
                    for col, v in zip(cols, (len(w) + 1, known, base, words, times), strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                part = batch.select([0, 1]).slice(row[0], len(row))
                total, codes, met = score(form)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(total), codes, met, pa.array([len(f) for f in form], pa.int64())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "words", "times", "score", "grams", "met", "size"],
                )

    return run


_SCORED = "held_out boolean, n_tokens bigint, n_known bigint, base double, words array<binary>, times array<bigint>, score double, grams array<bigint>, met array<bigint>, size bigint"


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, cached: int = CACHED, often: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Learns from the rows where ``held_out`` isn't true.  Scores are log10
    probabilities of the whole text, end included; ``bits_per_byte`` is the code length
    per byte of its normal form.  A null or wordless text is
    its end alone.  With nothing to learn from, words have the base
    probability 1 and each byte 1/256.  Repeated rows repeat, in training too.
    ``depth`` is 7 at most.  ``cached`` and ``often`` bound what each task knows of grams
    and words, and change no score.
    Only the id and text columns and those of ``held_out`` are read.
    """
    if not 1 <= depth <= 7:
        raise ValueError("depth must be 1 to 7")
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), as_bytes(text_col).alias("text"))
    met = source.select("held_out", "text").mapInArrow(_gathered(depth), "word binary, gram bigint, n bigint, met bigint")
    met = materialize(met.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met")), "counts")
    codes = gram_scores(met.where("gram is not null").select("gram", "n", "met"), depth)
    rank = _step(F.col("met"))
    least_met = _least_step(codes, F.col("met"), cached)
    top = codes.where(rank >= least_met).select("gram", "score").toArrow()
    code, value = top.column("gram").to_numpy().view(np.uint64), top.column("score").to_numpy()
    order = np.argsort(code)
    score = Scorer(code[order], value[order], depth)
    words = met.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    unit = total + 0.5 * (distinct + 1)
    end = next((r["n"] for r in words.where(F.col("word") == F.lit(END)).collect()), 0)
    words = words.where(F.col("word") != F.lit(END))
    least = _least_step(words, F.col("n"), often)
    known = (_step(F.col("n")) >= least) & (F.octet_length("word") <= WORD_BYTES)
    top = words.where(known).toArrow()
    top = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast((score, top, unit, end))
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(source.mapInArrow(_scored(shared), f"doc_id {kind}, {_SCORED}").withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(words.where(~known), "word", "left")
    term = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(unit))
    rare = rare.select("row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), term.alias("base"), F.lit(0.0).alias("score"))
    more = found.select("row", F.explode(F.arrays_zip("grams", "met")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.met").alias("times"))
    more = more.join(codes.where(rank < least_met).select("gram", F.col("score").alias("each")), "gram")
    more = more.select("row", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("each")).alias("score"))
    rest = rare.unionByName(more).groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")))
    whole = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    score = whole("score")
    return found.withColumnRenamed("n_known", "known").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        whole("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        whole("base").alias("base_score"),
        score.alias("score"),
        (-score * F.lit(math.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
