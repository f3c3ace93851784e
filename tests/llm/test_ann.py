import numpy as np
import pytest

from scholion.llm import ann
from scholion.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in asked:
        if q in ok:
            near = sorted((-float(v @ ok[q]), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def run(spark, rows, k=5):
    df = frame(spark, rows)
    out = {}
    for r in sorted(nearest(df, df.where("vec_id % 5 = 0"), k).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # copies: ties
    rows += [(200, None), (205, [0.0] * 6), (210, [1, None, 1, 1, 1, 1]), (215, [float("nan")] * 6), (220, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (225, [1.0, 2.0]), (230, [])]
    rows += [rows[5], rows[5]]
    got, want = run(spark, rows), brute(rows, [i for i, _ in rows if i is not None and i % 5 == 0], 5)
    want = {q: v for q, v in want.items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall_over_shards(spark, monkeypatch):
    r = np.random.default_rng(2)
    centre = r.normal(size=(30, 24))
    rows = [(i, (centre[i % 30] + r.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    got = run(spark, rows, 20)
    asked = [i for i, _ in rows if i % 5 == 0][::40]
    want = brute(rows, asked, 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in asked]
    assert np.mean(hits) >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i * 5, [1.0 + i, 2.0]) for i in range(n)]
    got = run(spark, rows)
    assert got == {q: v for q, v in brute(rows, [i for i, _ in rows], 5).items() if v}


def test_every_node_is_reached():
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(300, 4)), r.normal(size=(5, 4)) + 100]).astype(np.float32)
    graph, start = ann.build(x)
    seen, front = {start}, [start]
    while front:
        front = [int(j) for i in front for j in graph[i] if j >= 0 and j not in seen]
        seen.update(front)
    assert len(seen) == len(x)


def test_ties_of_different_vectors(spark):
    """Small integers: many scores are equal, and the smaller ids are the answer."""
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.integers(-1, 2, 6)]) for i in r.permutation(250)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for x in nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q, v in rows:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:20]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
