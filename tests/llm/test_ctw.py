import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.llm import ctw
from scholion.llm.ctw import END, grams, score_texts

SCHEMA = "doc_id long, text string, score string, row int"


def brute(train, texts, depth):
    """The definition, node by node."""
    form = lambda t: b" ".join((t or "").encode().lower().split()) + END
    seen = {}
    for t in train:
        s = END * depth + form(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                q = 1
                for k in range(8):
                    bit = s[i] >> (7 - k) & 1
                    seen.setdefault((s[i - d : i], q), [0, 0])[bit] += 1
                    q = q << 1 | bit

    def own(ab):
        a, b = ab
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    below = {}
    weighted = {}
    for (ctx, q), ab in sorted(seen.items(), key=lambda x: -len(x[0][0])):
        e = own(ab)
        weighted[ctx, q] = e if len(ctx) == depth else np.logaddexp(e, below[ctx, q]) - math.log(2)
        if ctx:
            below[ctx[1:], q] = below.get((ctx[1:], q), 0.0) + weighted[ctx, q]
    out = []
    for t in texts:
        s, total = END * depth + form(t), 0.0
        for i in range(depth, len(s)):
            q = 1
            for k in range(8):
                p = None
                for d in range(depth, -1, -1):
                    if (ab := seen.get((s[i - d : i], q))) is not None:
                        kt = (ab[1] + 0.5) / (sum(ab) + 1)
                        if p is None:
                            p = kt
                        else:
                            ratio = own(ab) - below[s[i - d : i], q]
                            share = 1 / (1 + math.exp(-ratio)) if ratio > -700 else 0.0
                            p = share * kt + (1 - share) * p
                p = 0.5 if p is None else p
                bit = s[i] >> (7 - k) & 1
                total += math.log10(p if bit else 1 - p)
                q = q << 1 | bit
        out.append(total)
    return out


def base(train, texts):
    tokens = lambda t: [*(t or "").encode().lower().split(), END]
    c = Counter(x for t in train for x in tokens(t))
    n = sum(c.values())
    return [(len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)) for t in texts]


@pytest.mark.parametrize("often,cached,depth", [(1 << 18, 1 << 21, 3), (2, 20, 2), (2, 0, 5), (20, 100, 1), (2, 50, 7)])
def test_against_the_definition(spark, often, cached, depth):
    r = random.Random(depth)
    texts = [" ".join(r.choice(["the", "The", "of", "tho", "é", "x\ty", "thought", "long" * 40]) for _ in range(r.randrange(0, 12))) for _ in range(40)]
    rows = [*enumerate([*texts, None, "", " \n", "unseen words Zq", texts[0]])]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    train = [t for i, t in rows if i % 3 != 1]
    got = {x.doc_id: x for x in score_texts(df, F.col("doc_id") % 3 == 1, depth=depth, cached=cached, often=often).collect()}
    assert len(got) == len(rows)
    for (i, _), want, (n, known, total, score) in zip(rows, brute(train, [t for _, t in rows], depth), base(train, [t for _, t in rows]), strict=True):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i % 3 == 1, n, known, total)
        assert math.isclose(x.base_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(x.score, want, rel_tol=1e-5, abs_tol=1e-6)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_probabilities_sum_to_one(spark, depth):
    code, n = np.unique(grams([b"abracadabra" * 5 + END, b"banana" + END], depth)[0], return_counts=True)
    seen = dict(zip(code.tolist(), n.tolist(), strict=True))
    after = list(itertools.product(b"abz\n", repeat=depth))
    every = [int.from_bytes(bytes([*context, b]), "big") for context in after for b in range(256)]
    counted = spark.createDataFrame([(c, seen.get(c, 0), 1) for c in {*every, *seen}], "gram long, n long, met long")
    got = {r.gram: r.score for r in ctw.gram_scores(counted, depth).collect()}
    assert len(got) == len({*every, *seen})
    for i in range(len(after)):
        assert math.isclose(sum(10 ** got[c] for c in every[256 * i : 256 * (i + 1)]), 1, rel_tol=1e-6)


def test_all_that_was_counted_has_its_place_in_the_tree(spark):
    # contexts met once count as others do, however many there are
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {x.doc_id: x.score for x in score_texts(df, F.col("doc_id") >= 290, cached=1000).collect()}
    for i, want in enumerate(brute(texts[:290], texts, ctw.DEPTH)):
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab", "s", 1), (None, None, "s", 1)], SCHEMA)
    got = {r.doc_id: r for r in score_texts(df, F.lit(True)).collect()}
    assert got[1].base_score == 0 and math.isclose(got[1].score, -3 * math.log10(256), rel_tol=1e-9)
    assert got[None].n_tokens == 1 and got[1].train_tokens == 0
    assert score_texts(df.limit(0), F.lit(False)).collect() == []
