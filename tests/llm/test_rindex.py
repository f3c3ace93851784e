import random

import pytest

from scholion.llm import rindex
from scholion.llm.rindex import RunLengthIndex, long_repeats


def brute(texts, window):
    seen = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), sum(gone), len(spans), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    line = lambda k: "".join(r.choice("abé ") for _ in range(k))
    shared = [line(r.randrange(10, 160)) for _ in range(6)]
    rows = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            rows.append(r.choice(rows))
        else:
            rows.append("".join(r.choice(shared) if r.random() < 0.5 else line(r.randrange(0, 60)) for _ in range(r.randrange(0, 6))))
    return rows


@pytest.mark.parametrize("seed,limits", [(0, {}), (1, {}), (2, {"group_bytes": 1}), (3, {"group_bytes": 1, "held_bytes": 200}), (4, {"group_bytes": 120, "held_bytes": 400})])
def test_against_brute_force(spark, seed, limits):
    """By the index, by hashes that are held, and by hashes that go on."""
    texts = [*corpus(seed), None, "", "a" * 300, "ab" * 90, "x" * 49]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    rows = {r.doc_id: r for r in long_repeats(df, window=50, **limits).collect()}
    got = {k: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for k, r in rows.items()}
    raw = [(t or "").encode() for t in texts]
    assert [got[i] for i in range(len(texts))] == brute(raw, 50)
    noticed, sampled = brute(raw, 30), brute(raw, 16)
    for i in range(len(texts)):
        longest = rows[i].longest_run
        assert longest >= 16 if noticed[i][1] else longest in (0, *range(16, 100))
        assert not longest or sampled[i][1]


def test_near_copies_in_a_large_group(spark):
    """Hundreds of edits of one text: hashes that are held, and those that go on."""
    r = random.Random(9)
    base = [r.choice("abcdefgh") for _ in range(400)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = "z"
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute([t.encode() for t in texts], 100)
    for limits in ({"group_bytes": 2000}, {"group_bytes": 2000, "held_bytes": 4000}):
        rows = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in long_repeats(df, window=100, **limits).collect()}
        assert [rows[i] for i in range(len(texts))] == want


def test_parts_of_long_texts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(rindex, "BLOCK", 300)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh") for _ in range(1500))
    texts = [base, base[100:900] + "zz" + base[1000:1400], "q" + base[:120]]
    found = set()
    import pyarrow as pa

    for data, offsets, _, _ in rindex._blocks(pa.array([t.encode() for t in texts], pa.binary()), 50):
        found.add(len(data))
        assert np.all(np.diff(offsets) >= 0)
    assert max(found) <= 300 + 49
    rows = rindex._occurrences(50, 0)(pa.RecordBatch.from_arrays([pa.array([b"a", b"b", b"c"]), pa.array([t.encode() for t in texts], pa.binary())], ["key", "text"]))
    covered = {k: sum(n for kk, n in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True) if kk == k) for k in (b"a", b"b", b"c")}
    assert covered == {k: len(t) - 49 for k, t in zip((b"a", b"b", b"c"), texts, strict=True)}


def test_matching_statistics():
    r = random.Random(3)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) for _ in range(8)]
    index = RunLengthIndex(parts)
    ms = index.matching_statistics()
    every = [(p, i) for p in range(len(parts)) for i in range(len(parts[p]))]
    for p, i in every:
        best = 0
        for q, j in every:
            if (p, i) != (q, j):
                a, b = parts[p][i:], parts[q][j:]
                best = max(best, next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))
        assert ms[index.starts[p] + i] == best
    assert len(index.letters) == len(index.heads) == len(index.tails) <= index.size == index.lengths.sum()
    assert all(a != b for a, b in zip(index.letters, index.letters[1:], strict=False))


def test_empty(spark):
    assert long_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
