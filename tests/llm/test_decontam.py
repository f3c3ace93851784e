import random
import re

import pytest

from scholion.llm.decontam import contaminated, contamination


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, bench):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item, t in bench:
            b = words(t)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 7, 40])
def test_against_brute_force(spark, block):
    r = random.Random(block)
    vocab = ["a", "B", "é", "x1", "-", "the", "Of;now"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, text(r.choice([1, 2, 3, 12, 13, 14, 30]))) for i in range(6)] + [(10, None), (11, "--"), (3, "the the the"), (None, "zz top")]
    docs = []
    for i in range(60):
        t = text(r.choice([0, 3, 20, 60, 400]))
        if r.random() < 0.5:
            t += " " + (r.choice(bench)[1] or "") + " " + text(r.choice([0, 30, 600]))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "zz, TOP"), (102, "zz, TOP"), (None, "a")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, item_id int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")
    found = contamination(d, b, block=block).withColumn("c", contaminated()).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"]), x.c) for x in found), key=str) == brute(docs, bench)
    assert all(sum(s.end - s.start for s in x.spans) == x.n_hit for x in found)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contamination(d, b).collect()] == [(1, 2, 0, [], [])]
    assert contamination(d.limit(0), b).collect() == []
