"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments.  The Manhattan
distance of two such vectors never exceeds the Hamming distance, so fingerprints
within two bits lie within Manhattan distance two, and two points that near share
a lattice point at distance one of both.  Each fingerprint therefore enters its
own grid cell and those one step away, and an equi-join of cells finds every
pair; the exact Hamming distance decides.

Only distinct fingerprints are joined, so copies cost nothing.  A cell of more
than ``CELL`` fingerprints is split by the exact fingerprints one bit away from
its members: those that share one are pairwise within two bits and hang on the
least of them, which keeps all connections without making pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, map_arrow, materialize, once, settled, splitmix
from scholion.llm.graph import components

SEED = 42
SEGMENT_BITS = 2
MAX_BITS = 2
CELL = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included; fewer words make one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h(join(w), SEED)], np.uint64)
    return np.fromiter((h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word of the bits set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[i : i + BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tables: int = 1, repeats: bool = True) -> DataFrame:
    """(id, fp array<long>): ``tables`` 64-bit fingerprints of each row's whole text.

    The first is that of XXH64; the others mix its hashes anew.  Without ``repeats``
    each shingle counts once.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, tables), np.uint64)
        for i, text in enumerate(batch.column(1).to_pylist()):
            hashes = shingle_hashes(text, words)
            hashes = hashes if repeats else np.unique(hashes)
            for k in range(tables):
                out[i, k] = majority(hashes)
                hashes = splitmix(hashes) if k + 1 < tables else hashes
        flat = pa.array(out.view(np.int64).ravel())
        fp = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, tables, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")), rows, f"id {kind}, fp array<bigint>")


def _names(segments: int) -> list[int]:
    """A random number for each segment and count; those of a vector, XORed, name its cell."""
    return splitmix(np.arange(1, segments * (SEGMENT_BITS + 1) + 1, dtype=np.uint64)).view(np.int64).tolist()


def _cells(fps: DataFrame, bits: int) -> DataFrame:
    """(tab, fp, ..) with ``cell``, a row for each cell at Manhattan distance 0 or 1.

    A step from a cell swaps one number in its name; a clash of names only adds a
    pair to be verified.
    """
    segments, most = bits // SEGMENT_BITS, SEGMENT_BITS
    names = f"array({', '.join(f'{x}L' if x > -(1 << 63) else f'-{(1 << 63) - 1}L' for x in _names(segments))})"
    count = f"transform(sequence(0, {segments - 1}), k -> bit_count(shiftrightunsigned(fp, k * {SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1}L))"
    rows = fps.withColumn("_c", once(F.expr(count))).withColumn("_n", once(F.expr(names)))
    own = f"aggregate(transform(_c, (x, k) -> _n[{most + 1} * k + x]), xxhash64(tab), (s, x) -> s ^ x)"
    rows = rows.withColumn("_own", once(F.expr(own)))
    step = lambda to: f"_own ^ _n[{most + 1} * k + x] ^ _n[{most + 1} * k + x {to}]"
    near = f"filter(flatten(transform(_c, (x, k) -> array(IF(x < {most}, {step('+ 1')}, NULL), IF(x > 0, {step('- 1')}, NULL)))), y -> y IS NOT NULL)"
    return rows.withColumn("cell", F.explode(F.concat(F.array("_own"), F.expr(near)))).drop("_c", "_n", "_own")


def _within(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, tab, root) sorted by cell to verified pairs (u, v) of different roots; rows of large cells pass with v null."""

    def pairs(cell: np.ndarray, fp: np.ndarray, tab: np.ndarray, root: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        u, v, t = [fp[large]], [np.zeros(large.sum(), np.int64)], [tab[large]]
        for step in range(1, CELL):
            near = np.nonzero((cell[step:] == cell[:-step]) & ~large[step:])[0]
            if not len(near):
                break
            a, b = fp[near], fp[near + step]
            ok = (a != b) & (root[near] != root[near + step]) & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits)
            u.append(a[ok]), v.append(b[ok]), t.append(tab[near][ok])
        alone = np.concatenate([np.full(len(x), k == 0) for k, x in enumerate(u)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(u)), pa.array(np.concatenate(v), mask=alone)], ["tab", "u", "v"])

    rest, ran = None, 0  # the last cell so far, of which ran rows have gone as rows of a large one
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        cell = now[0]
        if not len(cell):
            continue
        start = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
        size = np.diff(np.append(start, len(cell)))
        size[0] += ran
        large = np.repeat(size > CELL, np.diff(np.append(start, len(cell))))
        cut = start[-1] if not large[-1] else len(cell)
        if cut:
            yield pairs(*(x[:cut] for x in now), large[:cut])
        if large[-1]:  # its rows need not wait; those to come are known by one that is kept
            ran, rest = int(size[-1]), [x[-1:] for x in now]
        else:
            ran, rest = 0, [x[cut:] for x in now]
    if rest and not ran:
        yield pairs(*rest, np.zeros(len(rest[0]), bool))


def _paired(cells: DataFrame, max_bits: int) -> DataFrame:
    cells = cells.select("cell", "fp", "tab", "root").repartition("cell").sortWithinPartitions("cell")
    return materialize(cells.mapInArrow(lambda it: _within(it, max_bits), "tab int, u bigint, v bigint"), "pairs")


def links(fps: DataFrame, bits: int = 64, max_bits: int = MAX_BITS, every: bool = False) -> DataFrame:
    """(tab, u, v) that connect all distinct fingerprints (tab, fp) within ``max_bits`` (2 at most) bits of each other.

    Fingerprints with the same ``root``, if there is such a column, are connected
    already and not paired.  ``every``: also the members of a large cell are paired
    where one bit from a common fingerprint, and hang on the least only if they
    are over ``CELL`` there.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    root = F.col("root") if "root" in fps.columns else F.col("fp")
    fps = fps.select("tab", "fp", root.alias("root")).distinct()
    found = _paired(_cells(fps, bits), max_bits)
    pairs = found.where("v is not null").distinct()
    large = materialize(found.where("v is null").select("tab", F.col("u").alias("fp")).distinct(), "large")
    near = large.withColumn("near", F.expr(f"explode(transform(sequence(-1, {bits - 1}), k -> IF(k < 0, fp, fp ^ shiftleft(1L, k))))"))
    if max_bits < 2:  # one bit apart: the one is the other's flip
        near = near.where("near >= fp").join(large.select("tab", F.col("fp").alias("near")), ["tab", "near"]).select("tab", F.col("fp").alias("u"), F.col("near").alias("v"))
        return pairs.unionByName(near.where(f"u <> v and bit_count(u ^ v) <= {max_bits}"))
    if every:
        found = _paired(near.join(fps, ["tab", "fp"]).withColumn("cell", F.xxhash64("tab", "near")), max_bits)
        pairs = pairs.unionByName(found.where("v is not null").distinct())
        near = near.join(found.where("v is null").select("tab", F.col("u").alias("fp")).distinct(), ["tab", "fp"])
    least = near.groupBy("tab", "near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    star = near.join(least, ["tab", "near"]).where("fp <> v").select("tab", F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(star)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    A null or wordless text has fingerprint zero and is linked like any other; a
    text of fewer words than a shingle is one shingle.  Repeated rows repeat in
    the result.  A null id never becomes a component's id unless there is no
    other.  Only the id and text columns are read, so further columns may have
    any name.  An empty table gives an empty result.
    """
    base = fingerprints(docs, id_col, text_col, words).select(F.col("id").alias(id_col), F.col("fp")[0].alias("fp"))
    base = materialize(base, "fingerprints")
    least = base.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(base.select(F.lit(0).alias("tab"), "fp"), max_bits=max_bits).select("u", "v")).withColumnRenamed("node", "fp")
    known = materialize(least.join(roots, "fp", "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")
    whole = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(known.join(whole, "root").select("fp", "component_id"), "found")
    return base.join(found.hint("merge"), "fp", "left").select(
        F.col(id_col).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", F.col(id_col)).alias("component_id"),
    )


#: Bands of the long fingerprint, of so many bits, by which texts are compared.
BANDS = 12
BAND_BITS = 32
#: Bits of 384 that texts may differ in to be compared exactly: four deviations above the mean at a similarity of 0.8.
FAR = 86
#: Turns in which hubs link what is left of a group before all its pairs in different components are compared.
HUB_TURNS = 2
#: Pairs of texts of two values from which hubs are worth it, and that one block compares.
HUB_PAIRS = 1 << 12
PAIRS_AT_ONCE = 1 << 20


def _shingle_sets(words: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique((shingle_hashes(t, words) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    return rows


def _similar(similarity: float):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        on = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            on.append(both >= similarity * (len(x) + len(y) - both))
        return batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    return rows


def _apart(fa: str, fb: str) -> Column:
    """Bits in which two long fingerprints differ."""
    return sum((F.bit_count(F.col(fa)[k].bitwiseXOR(F.col(fb)[k])) for k in range(-(-BANDS * BAND_BITS // 64))), F.lit(0))


def _sets_of(source: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the texts of ``keys``, which are written before the join, so that the copies of a text can be split there."""
    met = materialize(keys.select("key").distinct(), "met")
    sets = map_arrow(source.select("key", as_bytes("text").alias("text")).join(met.hint("merge"), "key", "left_semi"), _shingle_sets(words), "key binary, shingles binary")
    return materialize(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")


def _linked(source: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b) of keys, those whose shingle sets are alike."""

    def alike() -> DataFrame:
        met = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = materialize(met.distinct(), "candidates")
        sets = _sets_of(source, met.select(F.explode(F.array("a", "b")).alias("key")), words)
        met = met.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
        return map_arrow(met.select("a", "b", "sa", "sb"), _similar(similarity), "a binary, b binary")

    return settled(alike, "alike")


def _numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Shingle sets as arrays, for functions of columns."""
    sets = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["key", "shingles"])


def _alike(a: str, b: str, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= F.lit(similarity) * (F.size(a) + F.size(b) - both)


def _unsettled(members: DataFrame, open_: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``members`` with their root so far, and the pairs of values whose texts have several; None if there are none."""
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "key")
    placed = materialize(members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    each = placed.groupBy("tab", "fp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("key").alias("k"))
    left = open_.join(each.select("tab", *(F.col(x).alias(y) for x, y in (("fp", "u"), ("lo", "lu"), ("hi", "hu"), ("n", "nu"), ("k", "ku")))), ["tab", "u"])
    left = left.join(each.select("tab", *(F.col(x).alias(y) for x, y in (("fp", "v"), ("lo", "lv"), ("hi", "hv"), ("n", "nv"), ("k", "kv")))), ["tab", "v"])
    left = left.where(F.least("lu", "lv") != F.greatest("hu", "hv")).select("tab", "u", "v", "ku", "kv", (F.col("nu") * F.col("nv")).alias("pairs"))
    left = materialize(left, "left")
    return placed, None if left.isEmpty() else left


def _staying(source: DataFrame, words: int, similarity: float, hub_pairs: int, pairs_at_once: int) -> DataFrame:
    """(key) of the texts of ``source`` (id, text, key) that ``drop_near_copies`` keeps."""
    tables = -(-BANDS * BAND_BITS // 64)
    prints = fingerprints(source, "key", "text", words, tables, repeats=False).withColumnRenamed("id", "key").groupBy("key").agg(F.first("fp").alias("fp"))
    prints = materialize(prints, "fingerprints")
    band = F.array(*(F.shiftrightunsigned(F.col("fp")[k * BAND_BITS // 64], k * BAND_BITS % 64).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for k in range(BANDS)))
    banded = prints.select("key", F.posexplode(band).alias("tab", "fp"))
    least = banded.groupBy("tab", "fp").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = banded.join(materialize(least.select("tab", "fp", F.col("key").alias("b")), "bands").hint("merge"), ["tab", "fp"]).where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    for k in "ab":
        same = same.join(prints.select(F.col("key").alias(k), F.col("fp").alias(f"f{k}")).hint("merge"), k)
    edges = _linked(source, same.where(_apart("fa", "fb") <= FAR), words, similarity)
    # what equal values have connected needs no pairs of near values
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "key")
    rooted = prints.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.posexplode(band).alias("tab", "fp"))
    least = rooted.groupBy("tab", "fp").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    least = materialize(least.withColumn("root", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(F.xxhash64("tab", "fp"))).drop("lo", "hi"), "bands")
    # with 32 bits a fingerprint has 33 neighbours at most, so that all pairs of values are here and no stars
    values = materialize(links(least, BAND_BITS, every=True).select("tab", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "values")
    ends = values.select("tab", F.col("u").alias("fp")).unionByName(values.select("tab", F.col("v").alias("fp"))).distinct()
    ends = materialize(ends.join(least, ["tab", "fp"]).select("tab", F.col("fp").alias("value"), "key").join(prints, "key"), "ends")
    near = values.join(ends.select("tab", F.col("value").alias("u"), F.col("key").alias("a"), F.col("fp").alias("fa")), ["tab", "u"])
    near = near.join(ends.select("tab", F.col("value").alias("v"), F.col("key").alias("b"), F.col("fp").alias("fb")), ["tab", "v"])
    edges = edges.unionByName(_linked(source, near.where(_apart("fa", "fb") <= FAR), words, similarity))
    # what has met the first of a value only: texts of values that hold several, by pairs of values
    several = least.where("n > 1").select("tab", "fp")
    open_ = values.join(several.select("tab", F.col("fp").alias("u")), ["tab", "u"], "left_semi").unionByName(values.join(several.select("tab", F.col("fp").alias("v")), ["tab", "v"], "left_semi").select("tab", "u", "v")).distinct()
    open_ = materialize(open_.unionByName(several.select("tab", F.col("fp").alias("u"), F.col("fp").alias("v"))), "open")
    ends = open_.select("tab", F.col("u").alias("fp")).unionByName(open_.select("tab", F.col("v").alias("fp"))).distinct()
    members = materialize(banded.join(ends, ["tab", "fp"]).join(prints.select("key", F.col("fp").alias("long")), "key"), "members")
    placed, left = _unsettled(members, open_, edges)
    for turn in range(HUB_TURNS):
        many = left.where(F.col("pairs") >= hub_pairs) if left else None
        if many is None or many.isEmpty():
            break
        # where values hold many texts, one of the component with the most there, and of the one with the fewest, meet all others
        own = placed.groupBy("tab", "fp", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("key", "long"), F.xxhash64("key", F.lit(turn))).alias("hub"))
        by = F.struct("n", F.xxhash64("root", F.lit(turn)))
        hubs = own.groupBy("tab", "fp").agg(F.array_distinct(F.array(F.max_by(F.struct("root", "hub"), by), F.min_by(F.struct("root", "hub"), by))).alias("hubs"))
        hubs = hubs.select("tab", F.col("fp").alias("v"), F.explode("hubs").alias("h")).select("tab", "v", F.col("h.hub.key").alias("b"), F.col("h.hub.long").alias("fb"), F.col("h.root").alias("rb"))
        both = many.select("tab", "u", "v").unionByName(many.where("u <> v").select("tab", F.col("v").alias("u"), F.col("u").alias("v")))
        met = both.join(hubs, ["tab", "v"]).join(placed.select("tab", F.col("fp").alias("u"), F.col("key").alias("a"), F.col("long").alias("fa"), F.col("root").alias("ra")), ["tab", "u"])
        edges = edges.unionByName(_linked(source, met.where(F.col("ra") != F.col("rb")).where(_apart("fa", "fb") <= FAR), words, similarity))
        placed, left = _unsettled(members, left.select("tab", "u", "v"), edges)  # what is settled stays so
    if left:  # each text of one value with each of the other, but for the first ones, which have met; in blocks of a bounded number of pairs
        left = left.withColumn("cuts", F.ceil(F.col("pairs") / pairs_at_once).cast("bigint"))
        values = left.select("tab", F.col("u").alias("fp")).unionByName(left.select("tab", F.col("v").alias("fp"))).distinct()
        placed = placed.join(values, ["tab", "fp"])
        sets = map_arrow(_sets_of(source, placed, words), _numbers, "key binary, shingles array<int>")
        placed = materialize(placed.join(sets, "key"), "unsettled")
        side = lambda fp, key, n: placed.select("tab", F.col("fp").alias(fp), F.col("key").alias(key), *(F.col(c).alias(f"{x}{n}") for c, x in (("long", "f"), ("root", "r"), ("shingles", "s"))))
        x = left.select("tab", "u", "v", "cuts", "ku", "kv").join(side("u", "a", "a"), ["tab", "u"]).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("cuts")))
        y = left.select("tab", "u", "v", "cuts").join(side("v", "b", "b"), ["tab", "v"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1))).drop("cuts")
        new = F.when(F.col("u") == F.col("v"), (F.col("a") < F.col("b")) & (F.col("a") != F.col("ku"))).otherwise((F.col("a") != F.col("ku")) | (F.col("b") != F.col("kv")))
        # the sets are compared as the pairs are made, so that only pairs that are alike leave the join
        met = x.drop("cuts").hint("merge").join(y, ["tab", "u", "v", "salt"]).where(new & (F.col("ra") != F.col("rb")) & (_apart("fa", "fb") <= FAR) & _alike("sa", "sb", similarity))
        edges = edges.unionByName(materialize(met.select("a", "b").distinct(), "alike"))
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "key")
    ids = source.groupBy("key").agg(F.min("id").alias("least"))
    ids = ids.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("key"))).alias("first"))
    return first.select("first.key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hub_pairs: int = HUB_PAIRS, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``docs`` with one document of each group of near copies.

    Texts are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more.  Candidates agree but for two bits in one of
    ``BANDS`` bands of a long fingerprint, found as in ``simhash_groups``; the sets
    decide.  Every candidate pair is compared unless its texts are linked already:
    texts of equal bands come first, then the first texts of near bands, then what is
    left between different components; ``hub_pairs`` and ``pairs_at_once`` only
    choose the order and size of that.  Of each group the row of the smallest id
    stays, of ties the smallest text hash, and one of rows equal in id and text.  Null texts are
    empty texts; texts without words, or with fewer than a shingle, are near
    copies of those with the same words only.  All columns pass through.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("key")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), key, row)
    stay = settled(lambda: _staying(source, words, similarity, hub_pairs, pairs_at_once), "stay")
    # copies meet in the tasks that read them, then one of each task
    copy = source.groupBy("key").agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"))).alias("row"))
    kept = copy.join(stay.hint("merge"), "key")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
