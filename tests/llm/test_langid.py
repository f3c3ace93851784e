import random

from pyspark.sql import functions as F

from scholion.llm.langid import UND, fit, identify

SCHEMA = "doc_id long, text string, lang string, lang_pred string"
SOUNDS = {"aa": ["ka", "no", "mi", "ra"], "bb": ["ül", "sch", "eit", "ung"], "cc": ["ción", "llo", "que", "ña"]}


def docs(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(SOUNDS))
        out.append((i, " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([3, 30, 200]))), lang, "x"))
    return out


def test_held_out_accuracy_and_rejection(spark):
    rows = docs(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = fit(df.where("doc_id % 3 <> 1"))
    assert sorted(set(model.langs)) == sorted(SOUNDS) and len(model.langs) > 3
    got = {r.doc_id: r for r in identify(df, model, extra={"held_out": F.col("doc_id") % 3 == 1}).collect()}
    held = [d for d in rows if d[0] % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.rejected for r in got.values()) == 0
    odd = spark.createDataFrame([(1, None, "aa", "x"), (2, "", "aa", "x"), (3, "12 %% 3.4", None, "x"), (4, "zzz xxx vvv www " * 60, None, "x"), (None, "kano mira " * 20, None, "x"), (5, "12 no 3", None, "x")], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == (UND, True)
    assert got[4][0] in SOUNDS and got[4][1]
    assert got[None] == ("aa", False) and got[5] == ("aa", False)


def test_bounded_sample_and_repeats(spark):
    rows = docs(2, 200)
    df = spark.createDataFrame(rows + [(999, rows[0][1], rows[0][2], "x")] * 200, SCHEMA)
    model = fit(df, per_language=20)
    got = {r.doc_id: r.lang_pred for r in identify(df.limit(200), model).collect()}
    assert sum(got.get(i) == lang for i, _, lang, _ in rows) / 200 > 0.95


def test_copies_do_not_thin_out_the_sample(spark):
    """Each of many languages with three texts in thousands of copies is learned."""
    sounds = ["ka", "no", "mi", "ra", "sch", "eit", "ung", "llo", "que", "tz", "wy", "bo"]
    texts = [(f"l{k:02}", " ".join(sounds[k] + c for c in x) * 9) for k in range(12) for x in ("abcde", "fghij", "klmno")]
    df = spark.createDataFrame(texts, "lang string, text string").crossJoin(spark.range(200))
    assert sorted(set(fit(df, per_language=10).langs)) == sorted({lang for lang, _ in texts})


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None, "x")], SCHEMA)
    assert [tuple(r) for r in identify(df, fit(df)).collect()] == [(1, UND, 0.0, True)]
    assert identify(df.limit(0), fit(df.limit(0))).collect() == []
