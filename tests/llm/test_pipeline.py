"""The pipeline on the smallest tables: every stage's decisions, and the whole against its own parts."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.tokens import encoder
from tests.llm.test_llm import WORD, classes_by_force, removed_by_force, targets_by_force


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good, one, cut, mixed, pieces = kept
    # 2: labelled documents of low quality go, others stay
    assert np.mean([labels[r.doc_id] == 1 for r in good if r.doc_id in labels]) > 0.97
    assert {r.doc_id for r in good} >= {d for d, q in labels.items() if q == 1} - {d for d in labels if len(source[d].text) < 40}
    # 3: the smallest doc_id of each class stays
    rows = sorted((r.doc_id, r.text) for r in good)
    assert sorted(r.doc_id for r in one) == sorted(min(g) for g in classes_by_force(rows))
    # 10: passages that an earlier document has are cut
    rows = sorted((r.doc_id, r.text) for r in one)
    left = {r.doc_id: r for r in cut}
    for (d, t), (n, gone, _) in zip(rows, removed_by_force(rows)):
        assert len(WORD.findall(left[d].text)) == n - gone and left[d].n_chars == len(left[d].text)
        assert gone or left[d].text == t
    # 6: sources near their targets
    size, taken = {}, {}
    for r in cut:
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
        assert r.text == left[r.doc_id].text
    for s, t in targets_by_force(size).items():
        assert abs(taken.get(s, 0) - t) <= 0.05 * t + 50
    # 1: every id of every copy in one piece
    e = encoder(tokenizer_path())
    assert sum(p.length for p in pieces) == sum(len(e.encode(r.text)) // 2 + 1 for r in mixed)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0 and out.count() > 0


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table go through all stages."""
    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("quality = 1 AND length(text) > 200").orderBy("doc_id").limit(8).collect()]
    rows = [(100_000 + k, t, "s") for k, t in enumerate(good)]
    rows += [(100_000, good[0], "s")] * 3 + [(200_000, good[1], None), (None, good[2], "s"), (None, None, None), (300_000, "", "s"), (300_001, None, "t"), (300_002, " ".join(good) * 40, "t")]
    names = ["score", "size", "copies", "node", "n_words", "n_removed", "chunk", "payload", "c0", "source_key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(n) for n in names))
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf_dir)
            path = str(tmp_path / f"{start is docs}{k}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == docs.columns and (now.count() > 0) == (start is docs)
                assert now.where("score <> 'clash' OR n_words <> 'clash' OR c0 <> 'clash'").count() == 0
            if k == 1 and start is docs:
                ids = [r.doc_id for r in now.collect()]
                assert ids.count(100_000) == 1 and 200_000 not in ids and len([d for d in ids if d in (300_000, 300_001)]) <= 1
        assert (now.count() > 0) == (start is docs)
