import hashlib
import random

from scholion.llm.lines import CHUNK, FACTOR, dedup_lines

SCHEMA = "doc_id long, text string, n_lines string, body string"


def brute(rows):
    first, cut = {}, []
    for doc, text in rows:
        parts = text.split("\n") if text is not None else []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in parts]
        chunks, now = [], []
        for i, x in enumerate(parts):
            now.append(x)
            if i == len(parts) - 1 or i and (h[i] + FACTOR * h[i - 1]) % CHUNK == 0:
                chunks.append(now)
                now = []
        cut.append(chunks)
        at = 0
        for c in chunks:
            place = ((doc is not None, doc), text, at)
            if len(c) > 1:
                first.setdefault("\n".join(c), []).append(place)
            at += len(c)
    out = []
    for (doc, text), chunks in zip(rows, cut, strict=True):
        kept, at, gone = [], 0, 0
        for c in chunks:
            places = first.get("\n".join(c), [])
            least = min((p[0], p[2]) for p in places) if places else None
            if len(c) > 1 and ((doc is not None, doc), at) != least:
                gone += len(c)
            else:
                kept += c
            at += len(c)
        out.append((doc, None if text is None else "\n".join(kept), at, gone))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    line = lambda: r.choice(["", "one", "two", "thrée", "a b"]) + str(r.randrange(0, 6))
    blocks = [[line() for _ in range(r.randrange(2, 9))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(0, 4)):
            parts += r.choice(blocks) if r.random() < 0.6 else [line() for _ in range(r.randrange(1, 4))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n".join(f"l{i % 7}" for i in range(3000))), (None, rows[5][1])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "body", "n_lines", "n_removed"]
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in out.collect()), key=str) == brute(rows)


def test_repeated_rows_stay_alike(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "x", "y"), (1, text, "x", "y"), (2, text, "x", "y")], SCHEMA)
    got = sorted((x.doc_id, x.n_removed) for x in dedup_lines(df).collect())
    assert got[0] == got[1] == (1, 0) and got[2][1] > 10
    assert dedup_lines(df.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", "y")], SCHEMA)
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
