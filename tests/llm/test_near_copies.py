import hashlib
import random

import numpy as np
import pytest

from scholion.llm import simhash
from scholion.llm.simhash import drop_near_copies

SCHEMA = "doc_id long, text string, row string, key int"


def jaccard(a, b):
    s = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def test_one_of_each_group_stays(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    base = [[word() for _ in range(150)] for _ in range(20)]
    rows, near = [], {}
    for i, w in enumerate(base):
        rows.append((10 * i + 5, w))
        for k in range(r.randrange(0, 4)):
            v = list(w)
            v[r.randrange(150)] = "new"
            rows.append((10 * i + k + 6, v))
            near[10 * i + k + 6] = 10 * i + 5
        v = [word() if r.random() < 0.3 else x for x in w]  # too far
        assert jaccard(v, w) < 0.8
        rows.append((1000 + i, v))
    data = [(i, " ".join(w), "x", 1) for i, w in rows]
    data += [(500, data[0][1], "x", 1), (500, data[0][1], "x", 1), (None, data[0][1], "x", 1), (600, None, "x", 1), (601, "", "x", 1), (602, " ", "x", 1), (603, "one two", "x", 1), (604, "one three", "x", 1)]
    out = drop_near_copies(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "text", "row", "key"]
    got = sorted(x.doc_id for x in out.collect())
    want = sorted([i for i, _ in rows if i not in near] + [600, 603, 604])
    assert got in (want, sorted([*want, 602]))
    assert drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"hub_pairs": 1, "pairs_at_once": 256}])
def test_hundreds_of_edits_of_one_text(spark, limits):
    """Edits are near the original and not each other, so that any other hub links none of them."""
    r = random.Random(11)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [base]
    for _ in range(300):
        v = list(base)
        for at in r.sample(range(0, 300, 6), 7):
            v[at] = "".join(r.choice("ijklmnop") for _ in range(5))
        texts.append(v)
    keys = [hashlib.md5(" ".join(t).encode()).digest() for t in texts]
    assert min(keys) != keys[0]
    fps = [long_print(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            meet = any((((a ^ b) >> s) & 0xFFFFFFFF).bit_count() <= 2 for a, b in zip(fps[i], fps[j], strict=True) for s in (0, 32))
            if meet and jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    want = len({find(i) for i in range(len(texts))})
    df = spark.createDataFrame([(i, " ".join(t), "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert drop_near_copies(df, **limits).count() == want


def test_repeats_do_not_hide_near_copies(spark):
    """Equal sets of shingles, but for a few, are near copies however often a footer stands there."""
    r = random.Random(6)
    body = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200))
    foot = " all rights are reserved by us here"
    df = spark.createDataFrame([(1, body + foot, "x", 1), (2, body + foot * 200, "x", 1)], SCHEMA)
    assert [x.doc_id for x in drop_near_copies(df).collect()] == [1]


def long_print(w):
    h = np.unique(simhash.shingle_hashes(" ".join(w).encode(), 5))
    out = []
    for _ in range(6):
        out.append(simhash.majority(h))
        h = simhash.splitmix(h)
    return out
