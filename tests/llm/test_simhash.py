import random

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import types as T

from scholion.llm import simhash
from scholion.llm.simhash import simhash_groups

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType())])


def brute(rows):
    def fp(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)
    out = simhash_groups(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in out.collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["Ab", "éa", "c\x0bd", "x1", "the", "of", "ÀB"]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            if r.random() < 0.6 and len(w) > 1:
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i * 3 + 1, " ".join(w)))
        else:
            rows.append((i * 3 + 1, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 200])))))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, monkeypatch):
    rows = [*corpus(seed), (2, None), (5, ""), (8, " \t\n"), (11, "a b"), (14, "long " * 30000)]
    assert run(spark, rows) == brute(rows)


def test_repeats_empty_and_null_id(spark):
    assert run(spark, []) == []
    rows = [(7, "same text here"), (7, "same text here"), (None, "same text here"), (9, "another text of words")]
    assert run(spark, rows) == brute(rows)


def test_links_of_crowded_cells(spark, monkeypatch):
    """All fingerprints two bits at most from a centre, so that cells are over full."""
    from scholion.llm.graph import components

    flips = [0] + [1 << i for i in range(63)] + [1 << i | 1 << j for i in range(0, 62, 2) for j in range(i + 1, 63, 5)]
    far = [(1 << 62) - 1, (1 << 61) - 1, 0b111 << 40]
    fps = [0x1234567812345678 ^ f for f in flips] + far
    df = spark.createDataFrame([Row(tab=0, fp=f) for f in fps], "tab int, fp bigint")
    for max_bits in (1, 2):
        found = {(r.u, r.v) for r in simhash.links(df, max_bits=max_bits).collect()}
        assert all((u ^ v).bit_count() <= max_bits for u, v in found)
        root = {r.node: r.root for r in components(simhash.links(df, max_bits=max_bits).select("u", "v")).collect()}
        want = {f: f for f in fps}

        def find(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= max_bits and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    want[y] = x
        assert {f: root.get(f, f) for f in fps} == {f: find(f) for f in fps}
