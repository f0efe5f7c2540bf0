from __future__ import annotations

import importlib

import public_tokenizers as P
import pytest

from test_dedup import brute_classes, brute_lines, brute_strings
from textmill.llm.packing import encoder
from textmill.llm.toxicity import fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    toxic = spark.createDataFrame([(5000 + i, f"some plain words here and a mudbrain or two number{i} of them", "en", "s", 1) for i in range(30)], docs.schema)
    docs.unionByName(toxic).write.parquet(f"{path}/documents.parquet")
    marks = [(r["doc_id"], 1, 0) for r in docs.collect()] + [(5000 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "suffix_array_dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def step(name, frame):
        out = stages[name](spark, frame, folder)
        out.write.parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        assert name == "packing" or back.columns == columns
        return back, [tuple(r) for r in back.collect()]

    before = [tuple(r) for r in docs.collect()]
    clean, rows = step("toxicity", docs)
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r[0] for r in rows} == {r["doc_id"] for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    assert not any(r[0] >= 5000 for r in rows) and len(rows) > len(before) - 35
    lines, after = step("line_dedup", clean)
    assert {r[0]: r[1] for r in after} == brute_lines(rows) and all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
    single, kept = step("minhash_near_dedup", lines)
    classes = brute_classes(after)
    assert sorted(r[0] for r in kept) == sorted({c for c in classes.values()})
    strings, left = step("suffix_array_dedup", single)
    assert {r[0]: r[1] for r in left} == {d: k.decode("utf-8", "ignore") for d, (k, _, _) in brute_strings(kept, 50).items()}
    _, pieces = step("packing", strings)
    encode = encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sum(p[2] for p in pieces) == sum(len(encode(r[1])) + 1 for r in left)


def test_run_and_empty_tables(spark, folder, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    assert pipeline.run(spark, folder).count() == spark.read.parquet(f"{folder}/packing").count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows(spark, folder):
    """Null ids, repeated rows and extra columns with names that operators use."""
    pipeline = importlib.import_module("corpus_pipeline")
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text, 1, "k"), (1, text, 2, "k"), (2, text, 3, None), (None, text, 4, "k"), (None, None, 5, "k"), (3, None, 6, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, kept string")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        left = out.collect()
        assert sum(r["doc_id"] is None for r in left) == 2, name
        assert sum(r["doc_id"] == 1 for r in left) == (1 if name == "minhash_near_dedup" else 2), name
        assert sum(r["doc_id"] == 2 for r in left) == (0 if name == "minhash_near_dedup" else 1), name
    assert pipeline.pack_sequences(spark, docs, folder).count() == 6


def test_no_text_is_lost_by_a_repeated_id(spark, folder):
    """Two texts that share an id, near copies of one of them elsewhere, exact repeats, null ids."""
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["minhash_near_dedup"]
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    near = b[:-1]
    rows = [(1, a), (2, a), (2, b), (3, near), (5, a), (5, a), (None, a), (None, a)]
    kept = lambda rows: sorted(map(tuple, stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder).collect()), key=repr)
    assert kept(rows) == [(1, a), (2, b), (None, a), (None, a)]
    # all texts under one id: each class keeps one
    c = " ".join(f"gamma{i}" for i in range(60))
    assert {t for _, t in kept([(7, a), (7, b), (7, c), (7, c), (7, "")])} == {a, b, c, ""}
    one = kept([(7, a), (7, b), (7, near), (8, near)])
    assert len(one) == 2 and (7, a) in one and {t for _, t in one} - {a} <= {b, near}
    # the smallest id of a class is found also where its text was renamed
    assert kept([(2, a), (2, b), (5, near), (2, near)])[0][0] == 2 and len(kept([(2, a), (2, b), (5, near)])) == 2
