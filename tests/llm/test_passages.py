import random

import numpy as np
import pytest

from scholion.llm import passages
from scholion.llm.passages import compact_windows, near_passages


def test_compact_windows_are_those_of_the_tree():
    """Every window of each part lies in the compact window of its least token, once."""
    r = np.random.default_rng(1)
    parts = [r.integers(0, 30, n).astype(np.uint64) for n in (3, 40, 7, 8, 60)]
    for _, own, start, more, at, value in compact_windows(parts, 8, 3):
        assert ((more <= at) & (at < 8)).all()
        seen = {}
        for p, s, m, v in zip(own, start, more, value, strict=True):
            for k in range(s, s + m + 1):
                assert (p, k) not in seen
                seen[p, k] = v
        assert set(seen) == {(p, k) for p, x in enumerate(parts) for k in range(len(x) - 7)}
        values = {}
        for (p, k), v in seen.items():
            values.setdefault(tuple(sorted(set(parts[p][k : k + 8].tolist()))), set()).add(int(v))
        assert all(len(v) == 1 for v in values.values())


def corpus(r, n=30, size=120):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    return [[word() for _ in range(size)] for _ in range(n)]


@pytest.mark.parametrize("cell", [12, 2])
def test_shared_passages(spark, cell):
    r = random.Random(cell)
    docs = corpus(r)
    passage = docs[0][20:75]
    for i in (3, 4, 9, 11):
        docs[i][30:85] = passage
    edited = docs[20][10:90]
    edited[40] = "CHANGED"
    docs[21][5:85] = edited
    docs[25] = list(docs[24])
    docs[26] = docs[27] = ["short", "copy"]
    docs[28][:20] = docs[29][:20]  # too short a passage
    rows = [(i, " ".join(w), "c", 1) for i, w in enumerate(docs)] + [(100, None, "c", 1), (101, "", "c", 1), (102, " ".join(docs[7]), "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, key int").repartition(3)
    got = {x.doc_id: x for x in near_passages(df, cell=cell).collect()}
    assert len(got) == len(rows)
    want = {i: i for i in got} | {3: 0, 4: 0, 9: 0, 11: 0, 21: 20, 25: 24, 102: 7}
    assert {i: x.class_id for i, x in got.items()} == want
    for i in (0, 3, 4, 9, 11):
        s = got[i].spans[0]
        assert len(got[i].spans) == 1 and abs(s.start - (20 if i == 0 else 30)) <= 12 and 50 <= s.end - s.start <= 55 + 24
        assert got[i].n_shared == s.end - s.start
    assert got[25].n_shared == got[102].n_shared == 120 and got[26].n_shared == 0 and got[28].n_shared == 0
    assert got[100].n_words == got[101].n_words == 0


def test_long_texts_and_empty(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 64)
    r = random.Random(8)
    a, b = corpus(r, 2, 900)
    b[300:420] = a[500:620]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (None, " ".join(b)), (3, "w " * 5000), (4, "w " * 5000)], "doc_id long, text string")
    got = {x.doc_id: x for x in near_passages(df).collect()}
    assert got[1].class_id == got[2].class_id == got[None].class_id == 1
    assert got[4].class_id == 3 and got[4].n_shared == 5000
    assert abs(got[1].spans[0].start - 500) <= 12 and abs(got[1].spans[0].end - 620) <= 12
    assert near_passages(df.limit(0)).collect() == []


def test_short_exact_passages_are_all_found(spark):
    """Passages of 50 to 65 words between otherwise unrelated texts: the window of the passage has all least tokens in common."""
    r = random.Random(21)
    docs = corpus(r, 400, 180)
    for i in range(0, 400, 2):
        n = 50 + i // 2 % 16
        a, b = r.randrange(0, 180 - n), r.randrange(0, 180 - n)
        docs[i + 1][b : b + n] = docs[i][a : a + n]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in near_passages(df).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_windows_alike_by_brute_force():
    r = np.random.default_rng(3)
    for top in (20, 1000):
        x, y = r.integers(0, top, 30).astype(np.uint32), r.integers(0, top, 25).astype(np.uint32)
        y[5:20] = x[3:18]
        want = [[len(a & b) >= 0.5 * len(a | b) for t in range(16) for b in [set(y[t : t + 10].tolist())]] for s in range(21) for a in [set(x[s : s + 10].tolist())]]
        assert np.array_equal(passages.alike(x, y, 10, 0.5), want)


def test_hashes_count_across_alignments():
    """Three rectangles of different shifts hold the same pair of starts."""
    at_a = np.array([(10 + k) << 24 | 20 << 16 | 8 << 8 | k for k in range(3)])
    at_b = np.array([(70 + k) << 24 | (20 + 2 * k) << 16 | 8 << 8 | k for k in range(3)])
    assert passages.overlaps(at_a, at_b, 3)[0] == (12, 18, 72, 78)
    assert not passages.overlaps(at_a, at_b, 4)


def test_spans_against_brute_force(spark):
    """Passages with a word changed: no word beyond what some pair of windows has alike, and every word of equal windows."""
    r = random.Random(31)
    docs = corpus(r, 16, 110)
    for i in range(0, 16, 2):
        n = 70 if i % 4 else 80
        docs[i + 1][10 : 10 + n] = docs[i][20 : 20 + n]
        if i % 4:
            docs[i + 1][45] = "changed"
    docs.append([*corpus(r, 1, 80)[0], *docs[0][20:100], *corpus(r, 1, 100)[0], *docs[0][20:100]])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    shingles = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in docs]
    windows = [[frozenset(s[i : i + 46]) for i in range(len(s) - 45)] for s in shingles]
    near, same = [set() for _ in docs], [set() for _ in docs]
    for a in range(len(docs)):
        for b in range(len(docs)):
            for i, x in enumerate(windows[a] if a != b else ()):
                for y in windows[b]:
                    both = len(x & y)
                    if both and both >= 0.8 * (len(x) + len(y) - both):
                        near[a].update(range(i, i + 50))
                        if x == y:
                            same[a].update(range(i, i + 50))
    for row in near_passages(df).collect():
        got = {k for s in row.spans for k in range(s.start, s.end)}
        assert same[row.doc_id] <= got <= near[row.doc_id]
    assert all(near) and all(same[i] for i in (0, 1, 4, 5, 16))


def linked(n, pairs):
    """The smallest member of each one's class."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


@pytest.mark.parametrize("seed", range(12))
def test_crowds_against_brute_force(seed):
    """Families of edited passages, equal ones, ones twice in a text and strangers, with one token in common."""
    r = np.random.default_rng(seed)
    w, similarity = (8, 0.6) if seed % 2 else (12, 0.8)
    key, start, rows = [], [], []
    bases = [r.integers(1, 40 if seed % 3 else 9, r.integers(w, 3 * w)) for _ in range(4)]
    for text in range(60):
        for _ in range(r.integers(1, 3)):
            x = bases[r.integers(0, 4)].copy() if r.random() < 0.8 else r.integers(1, 60, r.integers(w, 2 * w))
            for at in r.integers(0, len(x), r.integers(0, 5)):
                x[at] = r.integers(1, 10_000)
            x = np.insert(x[: r.integers(w, len(x) + 1)], w // 2, 0)[:-1].astype(np.uint32)
            key.append(text * 7), start.append(100 * len(start)), rows.append(x)
    windows = [(k // 7, s + i, frozenset(x[i : i + w].tolist())) for k, s, x in zip(key, start, rows, strict=True) for i in range(len(x) - w + 1)]
    pairs = [(a, b) for a in windows for b in windows if a[0] < b[0] and len(a[2] & b[2]) >= similarity * len(a[2] | b[2])]
    want, roots = [set() for _ in range(60)], linked(60, {(a[0], b[0]) for a, b in pairs})
    for pair in pairs:
        for text, s, _ in pair:
            want[text].update(range(s, s + w))
    for sort in (np.arange(len(key)), r.permutation(len(key))):
        a, b, starts = passages.crowd_links(np.array(key)[sort], np.array(start)[sort], [rows[i].tobytes() for i in sort], w, similarity)
        got = [set() for _ in range(60)]
        for k, part in zip(a, starts, strict=True):
            for s in part:
                got[k // 7].update(range(s, s + w))
        assert got == want
        assert linked(60, [(x // 7, y // 7) for x, y in zip(a, b, strict=True)]) == roots
        assert len(a) == len(set(a)) and all(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("parts", [1, 7])
def test_edits_of_one_passage_keep_every_link(spark, parts):
    """Many edits of a passage, few of them alike: classes and words are those of all pairs of windows, however rows are dealt."""
    r = random.Random(5)
    base = corpus(r, 1, 60)[0]
    docs = []
    for i in range(150):
        w = [x if r.random() > 0.012 else f"edit{i}x{k}" for k, x in enumerate(base)]
        if i % 5 == 0 and i:  # an edit of an edit, often too far from the passage itself
            w = list(docs[i - 1][20:80])
            w[r.randrange(60)] = f"again{i}"
        docs.append(corpus(r, 1, 20)[0] + w + corpus(r, 1, 20)[0])
    shingles = [[hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)] for w in docs]
    windows = [(d, i, frozenset(s[i : i + 46])) for d, s in enumerate(shingles) for i in range(len(s) - 45)]
    ids = {x: i for i, x in enumerate({x for s in shingles for x in s})}
    held = np.zeros((len(windows), len(ids)), np.float32)
    for k, (_, _, x) in enumerate(windows):
        held[k, [ids[y] for y in x]] = 1
    both, text = held @ held.T, np.array([d for d, _, _ in windows])
    near = (both >= 0.8 * (92 - both)) & (text[:, None] != text)
    roots = linked(150, set(zip(text[np.nonzero(near)[0]].tolist(), text[np.nonzero(near)[1]].tolist(), strict=True)))
    want = [set() for _ in docs]
    for k in np.flatnonzero(near.any(axis=1)).tolist():
        want[windows[k][0]].update(range(windows[k][1], windows[k][1] + 50))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(parts)
    got = {x.doc_id: x for x in near_passages(df).collect()}
    assert [got[i].class_id for i in range(150)] == roots
    assert [{k for s in got[i].spans for k in range(s.start, s.end)} for i in range(150)] == want


def test_crowds_over_batches():
    """Borders of batches change nothing: rows of crowds leave once, pairs of small groups all."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows = sorted({(int(t), int(k), int(s) * 10 << 24 | 3 << 8) for t, n in enumerate(r.integers(1, 12, 60)) for k, s in r.integers(0, 6, (n, 2))})
    rows = [x for x in rows for _ in range(r.integers(1, 3))]

    def met(size):
        cols = [[x[k] for x in rows] for k in range(3)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size], pa.int64()) for c in cols], passages.ROW) for i in range(0, len(rows), size)]
        return sorted((tuple(x.values()) for b in passages._meetings(iter(batches), 4) for x in b.to_pylist()), key=str)

    want = []
    for t in {x[0] for x in rows}:
        mine = sorted({x for x in rows if x[0] == t})
        if len(mine) > 4:
            want += [(k, None, p >> 24, (p >> 24) + 3, t) for _, k, p in mine]
        else:
            want += [(x[1], y[1], x[2], y[2], None) for i, x in enumerate(mine) for y in mine[i + 1 :] if x[1] != y[1]]
    for size in (1, 2, 7, 1000):
        assert met(size) == sorted(want, key=str)
