import random

import corpus_pipeline
from scholion.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, tmp_path):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    clean = [(i, " ".join(random.Random(i).choices(word, k=60)) + f" only {i}", "en" if i % 4 else None, "s", 1) for i in range(40)]
    bench = "the quick brown fox jumps over the lazy dog and runs into seven more woods today"
    rows = clean + [(100, clean[3][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "12 34 !!", "en", "s", 1), (103, bench, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs.write.parquet(str(tmp_path / f"out{k}"))
            docs = spark.read.parquet(str(tmp_path / f"out{k}"))
            left.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(range(40)) | {100, 101, 102, 103}
    assert left[0] == every - {101, 102}
    assert left[1] == left[0]
    assert left[2] == left[1] - {100}
    assert left[3] == set(range(40))
    got = docs.collect()
    assert {r.doc_id for r in got} == set(range(40))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
