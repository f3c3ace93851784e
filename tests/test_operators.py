"""Rules against plain restatements on random sequences, and small fixed cases."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from scholion.functions.fold import find_loosely, fold, folded_index, restored, strip_accents
from scholion.operators import entities, repair, segment, structure
from scholion.plans.engine import analyse
from scholion.plans.render import numbered, save
from scholion.sources import documents as sources

TOKEN = "doc_id int, sent int, tok int, text string, start int, stop int, ner string"


def frame(spark, sents, gap=0):
    rows = []
    for s, toks in enumerate(sents):
        at = 0
        for k, (text, ner) in enumerate(toks):
            rows.append((0, s, k, text, at, at + len(text), ner))
            at += len(text) + gap
    return spark.createDataFrame(rows, TOKEN)


def tags(df):
    out = {}
    for r in sorted(df.select("sent", "tok", "ner").collect()):
        out.setdefault(r.sent, []).append(r.ner)
    return [out[s] for s in sorted(out)]


def scan_numbers(toks):
    ner, i = [t[1] for t in toks], 0
    while i < len(toks):
        j = i
        if re.fullmatch(r"\d{1,3}", toks[i][0]):
            while j + 2 < len(toks) and toks[j + 1][0] in ".," and re.fullmatch(r"\d{3}", toks[j + 2][0]):
                j += 2
        if j > i:
            part = [t[1] for t in toks[i : j + 1]]
            label = next((x for x in ("MONEY", "QUANTITY") if any(x in p for p in part)), "CARDINAL")
            ner[i : j + 1] = ["B-" + label, *["I-" + label] * (j - i - 1), "E-" + label]
        i = j + 1
    return ner


def test_numbers_on_random_sequences(spark):
    r = random.Random(1)
    sents = [[(r.choice(["1", "22", "333", "984", "4444", ".", ",", "x"]), r.choice(["O", "S-MONEY", "B-QUANTITY", "S-CARDINAL"])) for _ in range(r.randrange(1, 12))] for _ in range(300)]
    assert tags(repair.merge_numbers(frame(spark, sents))) == [scan_numbers(s) for s in sents]


def test_numbers_need_no_space(spark):
    assert tags(repair.merge_numbers(frame(spark, [[("2", "O"), (".", "O"), ("100", "O")]], gap=1))) == [["O", "O", "O"]]


CASES = [
    ([("Γ", "S-PER"), (".", "O"), ("Καναρίου", "S-PER")], "B-PER I-PER E-PER"),
    ([("τοῦ", "O"), ("Γ", "O"), (".", "O"), ("Κατερίνη", "S-PER")], "O B-PER I-PER E-PER"),
    ([("τοῦ", "O"), ("Κ", "O"), (".", "O"), ("Γ", "S-PER"), (".", "O"), ("Κατζούλη", "S-PER")], "O B-PER I-PER I-PER I-PER E-PER"),
    ([("Δημ", "S-PER"), (".", "O"), ("Βαραγιάννη", "B-PER"), ("Ψαριανοῦ", "E-PER")], "B-PER I-PER I-PER E-PER"),
    ([("Ν", "S-GPE"), (".", "O"), ("Καρλόβασι", "S-GPE")], "B-GPE I-GPE E-GPE"),
    ([("Γρ", "S-PER"), (".", "O"), ("Παρ", "S-PER")], "S-PER O S-PER"),
    ([("Α", "O"), (".", "O"), ("Ορισμοί", "O")], "O O O"),
    ([("α", "O"), (".", "O"), ("ορισμοι", "S-PERSON")], "O O S-PERSON"),
    ([("του", "O"), ("γ", "O"), (".", "O"), ("κατερινη", "S-PERSON")], "O B-PER I-PER E-PER"),
]


def test_initials(spark):
    assert [" ".join(t) for t in tags(repair.merge_initials(frame(spark, [c for c, _ in CASES])))] == [w for _, w in CASES]


def scan_islands(ners):
    out, now = [], None
    for k, n in enumerate([*ners, "O"]):
        p = n[0]
        if p in "OBS":
            if now:
                out.append(now)
            now = [k] if p in "BS" else None
            if p == "S":
                out.append(now)
                now = None
        elif now:
            now.append(k)
            if p == "E":
                out.append(now)
                now = None
    return [(x[0], len(x)) for x in out]


def test_islands_on_random_tags(spark):
    r = random.Random(2)
    sents = [[("w", r.choice(["O", "B-X", "I-X", "E-X", "S-X"])) for _ in range(r.randrange(1, 10))] for _ in range(300)]
    got = entities.mentions_by_islands(frame(spark, sents).withColumn("dep", F.lit("d")).withColumn("head", F.lit("h")))
    found = sorted((x.sent, x.first, len(x.text.split())) for x in got.collect())
    assert found == [(s, a, n) for s, t in enumerate(sents) for a, n in scan_islands([x[1] for x in t])]


@pytest.mark.parametrize(
    "toks,want",
    [
        ("12/S-DATE - 1821/S-DATE", [("12-1821", "DATE")]),
        ("5/S-CARDINAL ευρώ/S-MONEY . x", [("5 ευρώ.", "MONEY")]),
        ("ν/S-LAW . 4548/S-CARDINAL", [("ν.4548", "LAW")]),
        ("12/S-DATE 5/S-LAW", [("12 5", "LAW")]),
        ("Α/B-PER Β/I-GPE Γ/E-PER Δ/I-PER", [("Α Β Γ", "PER")]),
        ("1/B-QUANTITY ,/I-QUANTITY 5/E-QUANTITY", [("1,5", "QUANTITY")]),
        ("Α/PERSON Β/S-ORG", [("Α", "PER"), ("Β", "ORG")]),
        ("Α/I-PER x", []),
    ],
)
def test_grown_mentions(toks, want):
    words = [{"tok": k, "text": (p := t.split("/"))[0] if t != "/" else "/", "ner": p[1] if len(p) > 1 and p[1] else "O", "pos": "PUNCT" if t in ".,/-" else "X", "dep": "", "head": "", "start": k, "stop": k + 1} for k, t in enumerate(toks.split())]
    assert [(m["text"], m["label"]) for m in entities.read_mentions(words)] == want


def test_folding(spark):
    df = spark.createDataFrame([("ᾧ Τοῦ ΟΔΟΣ. ﬁ½", "το  υ", "εἶπε ΤΟΎ ναι")], "a string, n string, r string")
    row = df.select(strip_accents(F.col("a")), fold(F.col("a")), folded_index(F.col("a")), find_loosely(F.col("n"), fold(F.col("r")))).first()
    assert row[0] == "ω Του ΟΔΟΣ. fi1⁄2" and row[1].startswith("ω του οδοσ")
    assert row[2].folded.startswith("ω του οδοσ") and row[2].idx[:3] == [0, 1, 2]
    assert (row[3]["at"], row[3]["length"]) == (6, 3)


def random_texts(spark, seed, n=60, words=()):
    r = random.Random(seed)
    words = words or [" ", " ", " ", "\n", "\n\n", " \n\n ", ".", ",", "!", "/", "-", "αρ", "τηλ", "ΥΠ", "λ", "1", "22", "333", "984", "1821", "4444", "€", "λόγος", "x"]
    rows = [(i, "".join(r.choice(words) for _ in range(r.randrange(0, 90)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (None, "a. b\n\nc")], "doc_id long, text string").repartition(3)


def compared(df, *columns):
    return sorted(map(str, df.select("doc_id", "tok", "text", "start", "stop", *columns).collect()))


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_sentences_as_rules_and_as_windows(spark, monkeypatch, block):
    monkeypatch.setattr(segment, "BLOCK", block)
    for suffix in (False, True):
        df = random_texts(spark, suffix)
        want = segment.sentences(segment.sentence_starts(segment.tokens(df), suffix))
        got = segment.tokens(df, rules=[segment.starts_rule(suffix), segment.sentences_rule()])
        assert compared(got, "blank", "starts", "sent", "para") == compared(want, "blank", "starts", "sent", "para")


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_numbers_as_rules_and_as_windows(spark, monkeypatch, block):
    monkeypatch.setattr(segment, "BLOCK", block)
    df = random_texts(spark, 5, words=["1", "22", "333", "333", "984", "1821", ".", ".", ",", " ", "€", " €", " x "])
    tag = lambda text, tok: F.when(tok % 7 == 0, "S-MONEY").when(tok % 3 == 0, "B-QUANTITY").otherwise("O")
    want = repair.merge_numbers(segment.tokens(df).withColumn("ner", tag(F.col("text"), F.col("tok"))), ["doc_id"])
    got = segment.tokens(df, rules=[repair.numbers_rule(tag)]).withColumn("ner", repair.merged(F.col("part"), tag(F.col("text"), F.col("tok"))))
    assert compared(got, "ner") == compared(want, "ner") and got.where("part > 0").count() > 20
    want = repair.merge_numbers(entities.rule_tags(segment.tokens(df).where("not blank").withColumn("sent", F.lit(0))))
    got = segment.tokens(df, rules=[entities.numbers_rule(), repair.numbers_rule()])
    got = got.withColumn("ner", repair.merged(F.col("part"), entities.number_tag(F.col("text"), F.col("money"))))
    assert compared(got, "ner") == compared(want, "ner") and got.where("money").count() > 5


@pytest.mark.parametrize("name", ["sentence_starts", "paragraph_index", "dotted_numbers", "entities_by_source"])
def test_tokens_of_texts_are_not_sorted(spark, tmp_path, name):
    """Sorts of tokens took 7 times the input's disk."""
    from scholion import queries

    random_texts(spark, 9).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_entities_by_source_joins_numbers_before_it_tags(spark, tmp_path):
    """A joined number is one CARDINAL, whatever sign its last token stands before."""
    from scholion import queries

    texts = ["1.234$$$ 22.333.984 € 7,500\n$", "22 $ 333. 984 € 12.34 £", "1821. 1821.984 $ 1821$"]
    df = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.label): r.n for r in queries.entities_by_source(spark, str(tmp_path)).collect()}
    want = {("s0", "CARDINAL"): 3, ("s1", "MONEY"): 3, ("s1", "CARDINAL"): 2, ("s2", "DATE"): 2, ("s2", "MONEY"): 2}
    assert got == want


def test_sentences(spark):
    texts = ["Σύντομη ιστορία\n\nΗ επέκταση\n\nΟ Ιωάννης", "Τίτλος\n \n\nΚείμενο", "πρώτη γραμμή\nδεύτερη", "με τον ν.\n\nΆρθρο πρώτο", "τον ν. 4548 ναι. Όχι"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    toks = segment.tokens(df)
    for r in toks.join(df.withColumnRenamed("text", "whole"), "doc_id").collect():
        assert r.whole[r.start : r.stop] == r.text
    got = {}
    for r in segment.sentence_starts(toks).where("starts").orderBy("doc_id", "tok").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {0: ["Σύντομη", "Η", "Ο"], 1: ["Τίτλος", "Κείμενο"], 2: ["πρώτη"], 3: ["με", "Άρθρο"], 4: ["τον", "Όχι"]}
    found = segment.sentence_table(segment.sentences(segment.sentence_starts(toks)))
    assert all(texts[r.doc_id][r.start : r.stop] == r.text for r in found.collect())


def test_chunks(spark):
    words = ["word", "x"] * 500
    toks = spark.createDataFrame([(0, 0, k, w if k % 100 else ",", False) for k, w in enumerate(words)], "doc_id int, sent int, tok int, text string, blank boolean")
    out = segment.chunks(toks, measure=lambda t: F.lit(1)).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", "tok").alias("last")).orderBy("chunk").collect()
    assert [(r.n, r.last) for r in out] == [(401, ","), (400, ","), (199, "x")]
    assert segment.chunks(toks.limit(400), measure=lambda t: F.lit(1)).select("chunk").distinct().count() == 1


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


@pytest.mark.parametrize(
    "body,want",
    [
        (P.format("Α") + "<w:p/>" + P.format("Β"), "Α\n\nΒ"),
        ("<w:p><w:r><w:t>Κα</w:t></w:r><w:r><w:t>λή</w:t></w:r></w:p>", "Καλή"),
        ("<w:p><w:r><w:t>Α</w:t><w:tab/><w:t>Β</w:t><w:br/><w:t>Γ</w:t><w:noBreakHyphen/><w:t>Δ</w:t><w:softHyphen/><w:t>Ε</w:t></w:r></w:p>", "Α Β\nΓ-ΔΕ"),
        ("<w:tbl><w:tr><w:tc>" + P.format("Πόλη") + "</w:tc><w:tc>" + P.format("Περιοχή") + "</w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>", "Πόλη; Περιοχή"),
        ("<w:sdt><w:sdtContent>" + P.format("x") + "</w:sdtContent></w:sdt><w:sectPr/>", "x"),
    ],
)
def test_docx(body, want):
    assert sources.docx_text(docx(body)) == want


def test_documents(spark):
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("x", "y")
    files = [("a/x.docx", docx(P.format("ναι"))), ("a/y.docx", b"no zip"), ("a/z.DOCX", bad.getvalue()), ("a/e.docx", docx("")), ("a/b.MD", "τί".encode()), ("a/c.txt", b"\xff\xfe"), ("a/d.doc", b"")]
    got = {r.source_name: (r.text, r.error is None) for r in sources.imported(spark.createDataFrame([(a, bytearray(b)) for a, b in files], "path string, content binary")).collect()}
    assert got == {"x.docx": ("ναι", True), "y.docx": (None, False), "z.DOCX": (None, False), "e.docx": (None, False), "b.MD": ("τί", True), "c.txt": (None, False), "d.doc": (None, False)}
    assert sources.inline_text(spark, " ").first().error and sources.inline_text(spark, "x").first().text == "x"


def test_saved(spark, tmp_path):
    good = spark.createDataFrame([("a" * 32, " ", "2024-01-02T03:04:05", "f.txt", "1", "{}"), ("b" * 32, "t", "2024-02-02T03:04:05", "g.txt", "1", "{}"), ("nope", "t", None, "g", "1", "{}")], "id string, title string, timestamp string, filename string, version string, data string")
    save(good, str(tmp_path / "s"))
    (tmp_path / "s" / "broken.json").write_text("{not json\n")
    saved = sources.read_saved(spark, str(tmp_path / "s"))
    assert [(r.id[0], r.title) for r in sources.catalog(saved).collect()] == [("b", "t"), ("a", "f.txt")]
    assert sources.load(saved, "a" * 32).count() == 1 and sources.load(saved, "nope").count() == 0


def test_analysis(spark):
    text = "# Τίτλος\n\nΟ Γ. Καναρίου πλήρωσε 1.500€ το 1821.\n\nΝέα παράγραφος; Ναι."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("Καναρίου", "PER")], "text string, label string")
    a = analyse(docs, tagger=lambda t: entities.rule_tags(t, names))
    clean = a.documents.where("doc_id = 1").first().text
    assert sorted((clean[m.start : m.stop], m.label) for m in a.spans.collect()) == [("1.500 €", "MONEY"), ("1821", "DATE"), ("Γ. Καναρίου", "PER")]
    its = a.items.orderBy("ent_id").where("is_ent").collect()
    assert [(i.text, i.ner, i.ent_id) for i in its] == [("Γ. Καναρίου", "PER", 1), ("1.500", "MONEY", 2), ("1821", "DATE", 3)]
    index = {r.label: [(e.ent_id, e.text) for e in r.entities] for r in a.index.collect()}
    assert index["PER"] == [(1, "Γ. Καναρίου")]
    page = a.html.where("doc_id = 1").first().html
    assert page.count("<mark") == 3 and 'id="ent-3"' in page and "Paragraph 3" in page
    assert {r.address for r in a.addresses.collect()} >= {"1.1.1", "2.1.2", "3.2.1"}


def test_items_remap_heads(spark):
    rows = [(0, 0, 0, 1, "Νέα", "B-GPE", "X", "root", "ROOT", 0), (0, 0, 0, 2, "Υόρκη", "E-GPE", "X", "flat", "Νέα", 1), (0, 0, 0, 3, "είναι", "O", "X", "cop", "Υόρκη", 2), (0, 0, 1, 1, "ορφανό", "I-ORG", "X", "root", "ROOT", 0)]
    toks = spark.createDataFrame(rows, "doc_id int, para int, sent int, tok int, text string, ner string, pos string, dep string, head string, head_id int")
    got = [(i.sent, i.id, i.text, i.ent_id, i.head_id) for i in structure.items(toks).orderBy("sent", "id").collect()]
    assert got == [(0, 1, "Νέα Υόρκη", 1, 0), (0, 3, "είναι", None, 1), (1, 1, "ορφανό", 2, 0)]


def test_stream_equals_batch(spark, tmp_path):
    from scholion.streaming.documents import follow, read_stream

    rows = [(i, f"Το {1800 + i} πλήρωσε {i}.500€ εκεί.") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.json(str(tmp_path / "in"))
    seen = []
    follow(read_stream(spark, str(tmp_path / "in")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    want = analyse(spark.createDataFrame(rows, "doc_id long, text string")).items.collect()
    assert sorted(map(str, seen)) == sorted(map(str, want)) and seen


def test_spans_move_with_what_is_trimmed(spark):
    said = "Στις 12 έως χθες, 5 /3 και κατά το άρθρο 7 του ν. 45) δίνει 30 ευρώ ., ναι"
    rows = [("DATE", "Στις 12 έως"), ("DATE", "/3"), ("LAW", "ν. 45)"), ("MONEY", "30 ευρώ .,"), ("PER", "ναι")]
    found = spark.createDataFrame([(1, 0, k, label, "", said.index(m) + 100, said.index(m) + len(m) + 100) for k, (label, m) in enumerate(rows)], "doc_id int, sent int, first int, label string, text string, start int, stop int")
    sents = spark.createDataFrame([(1, 0, 100, said)], "doc_id int, sent int, start int, text string")
    got = entities.placed(found, sents).orderBy("first").collect()
    assert [r.text for r in got] == ["12", "5 /3", "άρθρο 7 του ν. 45", "30 ευρώ", "ναι"]
    assert all(said[r.start - 100 : r.stop - 100] == r.text for r in got)


def test_a_sentence_of_many_tokens(spark):
    """Work on a sentence grows with its tokens, not with their square."""
    toks = spark.range(50_000).selectExpr("1 AS doc_id", "0 AS para", "0 AS sent", "cast(id + 1 AS int) AS tok", "concat('w', id) AS text", "IF(id % 9 = 0, 'S-PER', 'O') AS ner", "'X' AS pos", "'dep' AS dep", "cast((id * 7) % 50000 AS int) AS head_id")
    its = structure.items(structure.heads(toks))
    assert its.count() == 50_000 and structure.edges(its).count() > 40_000


def test_batch_tagger(spark):
    def capitals():
        return lambda sents: [[("S-PER" if w[:1].isupper() else "O", "X", "root" if k == 0 else "dep", min(k, 1)) for k, w in enumerate(s)] for s in sents]

    toks = spark.createDataFrame([(d, s, k, w) for d in range(3) for s in range(70) for k, w in enumerate(["Άννα", "είδε", f"Γ{s}"])], "doc_id int, sent int, tok int, text string")
    got = entities.batch_tagger(capitals, 16)(toks.repartition(3)).collect()
    assert len(got) == 630 and all((r.ner == "S-PER") == (r.tok != 1) and r.head_id == min(r.tok, 1) for r in got)


def test_stored_analysis(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Το 1821 πλήρωσε 1.500€.")], "doc_id long, text string")
    a, b = analyse(docs), analyse(docs, store=str(tmp_path / "a"))
    assert sorted(map(str, a.items.collect())) == sorted(map(str, b.items.collect()))
    assert sorted(map(str, a.html.collect())) == sorted(map(str, b.html.collect()))


def test_words_get_their_form_back(spark):
    text = "Ὁ Ἄνθρωπος, 12 ΛΌΓΟΣ· e\u0301te"
    rows = [(1, text, ["ο", "ανθρωποσ", "12", "λογος", "ete"]), (2, "Abc xyzw Def", ["abc", "q", "def"]), (3, "Abc xyzw Def", ["abc", "qqqq", "def"]), (4, None, ["a"]), (5, "a", []), (6, "aa bb", ["", "bb", "aa"])]
    df = spark.createDataFrame(rows, "doc_id int, text string, words array<string>")
    got = {r.doc_id: r.x and [tuple(w) for w in r.x] for r in df.select("doc_id", restored(F.col("text"), F.col("words")).alias("x")).collect()}
    assert [w[0] for w in got[1]] == ["Ὁ", "Ἄνθρωπος", "12", "ΛΌΓΟΣ", "e\u0301te"]
    assert all(text[a:b] == w for w, a, b in got[1])
    assert got[2] == [("Abc", 0, 3), ("q", None, None), ("def", None, None)]  # four letters are too many for one that was missed
    assert got[3] == [("Abc", 0, 3), ("qqqq", None, None), ("Def", 9, 12)]
    assert got[4] is None and got[5] == []
    assert got[6] == [("", None, None), ("bb", 3, 5), ("aa", None, None)]


def test_engine_of_each_document(spark):
    docs = spark.createDataFrame([(i, "Η Άννα πήγε το 1821 με 12 €.", e) for i, e in enumerate(["modern", "ancient", None, "modern"])], "doc_id int, text string, engine string")
    got, one = analyse(docs, F.col("engine")), {e: analyse(docs, e) for e in ("modern", "ancient")}
    for name in ("tokens", "mentions", "spans", "items", "html", "order"):
        want = [r for e, ids in (("modern", [0, 3]), ("ancient", [1, 2])) for r in getattr(one[e], name).where(F.col("doc_id").isin(ids)).collect()]
        assert sorted(map(str, getattr(got, name).collect())) == sorted(map(str, want))


def test_marks_beyond_the_spans(spark):
    mark = '<mark class="entity" style="x">'
    df = spark.createDataFrame([(f"a {mark}b</mark> {mark}c</mark>",), (f"{mark}b</mark>{mark}c</mark>",), ("no",)], "html string")
    spans = F.array(F.struct(F.lit("P&Q").alias("label"), F.lit("d").alias("dep"), F.lit(None).cast("string").alias("head")))
    said = lambda n, label, dep: f'<mark class="entity" id="ent-{n}" data-entity="{label}" data-dep="{dep}" data-head="" tabindex="-1" style="x">'
    got = [r[0] for r in df.select(numbered(F.col("html"), spans)).collect()]
    assert got == [f"a {said(1, 'P&amp;Q', 'd')}b</mark> {said(2, 'UNKNOWN', '')}c</mark>", f"{said(1, 'P&amp;Q', 'd')}b</mark>{said(2, 'UNKNOWN', '')}c</mark>", "no"]


def test_only_complete_analyses_are_saved(spark, tmp_path):
    rows = [("a" * 32, "complete"), ("b" * 32, "running"), (None, "complete"), ("c" * 32, None)]
    tasks = spark.createDataFrame(rows, "id string, status string")
    told = tasks.select("*", F.lit("t").alias("title"), F.lit("f.txt").alias("filename"), F.current_timestamp().alias("timestamp"), F.lit("1").alias("version"), F.lit("{}").alias("data"))
    refused = save(told, str(tmp_path / "s")).collect()
    assert sorted(str(r.id)[0] for r in refused) == ["N", "b", "c"]
    assert [r.id[0] for r in sources.read_saved(spark, str(tmp_path / "s")).collect()] == ["a"]
    more = tasks.select("*", F.lit(1).alias("progress"), F.lit(2).alias("total"), F.lit(None).cast("string").alias("error"))
    found = sources.statuses(more, spark.createDataFrame([("b" * 32,), ("zz",)], "id string")).collect()
    assert {r.id[0]: (r.status, r.progress) for r in found} == {"b": ("running", 1), "z": ("not_found", None)}
