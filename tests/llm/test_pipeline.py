import random

from llm_odd import ODD, rows_of
from test_near_dup import classes
from test_quality import corpus, measured_slowly
from test_tokens import check_packing

import corpus_pipeline
from argentum.llm import quality_crf
from argentum.llm.quality_rules import verdict


def tables(spark, tmp_path, rows, marks):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def long_corpus():
    rows, marks = corpus(160)
    rng = random.Random(1)
    more = []
    for i, t in rows:
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}x" for _ in range(60)]
        more.append((i, t + "\n" + " ".join(words).capitalize() + "."))
    more += [(1000 + i, t) for i, t in more[:10]]  # exact copies
    more += [(2000 + i, t + " tail") for i, t in more[20:30]]  # near copies
    return more, marks


def test_stages_equal_brute_force(spark, tmp_path):
    rows, marks = long_corpus()
    sf_dir = tables(spark, tmp_path, rows, marks)
    text = dict(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    a = first(spark, docs, sf_dir)
    kept = {i for i, t in rows if quality_crf.score(t, model) >= 0.3}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept
    b = second(spark, a, sf_dir)
    kept = {i for i in kept if verdict(measured_slowly(text[i]))[1]}
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == kept
    c = third(spark, b, sf_dir)
    kept = {i for i, k in classes([(i, text[i]) for i in sorted(kept)]).items() if i == k}
    assert sorted(c.columns) == sorted(docs.columns) and {r.doc_id for r in c.collect()} == kept
    packed = last(spark, c, sf_dir).collect()
    assert {r.doc_id for r in packed} == kept
    check_packing(packed, 2048)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    sf_dir = tables(spark, tmp_path, ODD, [(1, 1), (6, 0), (None, 1), (7, None)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert len(out.collect()) > 0 or name == "quality_rules"
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id") == []
