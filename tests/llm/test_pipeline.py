"""The whole pipeline on awkward tables, and the tables that it leaves."""

import random

import pytest

import corpus_pipeline
from duelframe.llm import exact_dedup
from duelframe.llm.base import WRITTEN, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _at long, _len string, n int"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "gläser", "cut", "tree"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(25, 90)), "en", f"src{i % 4}", None) for i in range(60)]
    rows += [(100, rows[7][1] + " ", "en", "src1", 3), (101, None, None, None, None), (102, "", "en", "src0", 0), rows[9], rows[9],
             (None, rows[11][1], "en", None, 1), (None, sentence(rng, 60), None, None, 1), (103, sentence(rng, 20_000), "de", "src9", 2)]
    words = rows[20][1].split()
    rows += [(104, " ".join([*words[:-1], "other"]), "en", "src2", 1), (105, "short text", "en", "src2", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, "x", 1, "y", 0) for r in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_keep_columns_and_drop_what_they_should(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, path), f"test{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect()) for d in seen[:3]]
    assert not {101, 102, 105} & {i for _, i in ids[0]}  # empty and short texts fail the base rules
    assert ids[1].count((False, 9)) == 1 and (False, 7) not in ids[1] and (False, 100) in ids[1]  # the longer of two equal texts
    assert ids[1].count((True, 0)) == 1  # a null id comes after a known one of the same text
    assert (False, 104) not in ids[2] and (False, 20) in ids[2]


def test_run_gives_pieces_and_leaves_one_stage(spark, sf):
    before = set(WRITTEN)
    out = corpus_pipeline.run(spark, sf[0])
    assert out.count() > 50
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in WRITTEN if p not in before]
    assert [t for t in left if t.startswith("stage")] == ["stage3"]
    assert not {"sketch", "classes", "sets", "levels"} & set(left)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keep_best_agrees_with_the_groups(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in exact_dedup.keep_best(docs).collect()}
    best = exact_dedup.duplicate_groups(docs).where("kept").select("doc_id").distinct().collect()
    assert {i for i, _ in kept} == {r.doc_id for r in best}
    assert exact_dedup.keep_best(docs).count() == len(kept)
