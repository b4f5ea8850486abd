"""What the pipeline's driver and workers are spared."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tradelake.llm import quality

ROWS = "doc_id long, text string, source string, lang string, n_chars long"


def test_the_driver_gets_telling_buckets_alone_and_fits_what_whole_rows_give(spark, monkeypatch):
    rnd = random.Random(5)
    words = [rnd.choice("abcdefgh") + str(k) for k in range(3000)]
    rows = [(i, " ".join(rnd.sample(words, 30)) + (" BAD!!" if i % 4 == 0 else " good"), f"s{i % 4}", "en", 30) for i in range(240)]
    rows += rows[:2] + [(4, "another text BAD!! of the same id", "s0", "en", 30)]
    docs = spark.createDataFrame(rows, ROWS).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(180)], "doc_id long, quality int, toxic int")
    given = []

    class Seen(quality.CoTraining):
        def __init__(self, *args):
            given.append(args)
            super().__init__(*args)

    monkeypatch.setattr(quality, "CoTraining", Seen)
    heads = quality.train(docs, labels)
    monkeypatch.undo()
    assert len(given) == 2
    for args in given:
        assert all(set(r.index.tolist()) <= set(np.concatenate([g[3][v] for g in given]).tolist()) for r, v in zip(args[:2], ("text", "meta"), strict=True))
    features = quality.materialise(quality._prepared(docs, ["doc_id"], labels), "test-features")
    own = features.selectExpr("row.doc_id", "text", "meta", "quality", "toxic", "xxhash64(text, meta) mark").where("quality is not null").collect()
    own.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.mark))
    whole = [quality.Rows.of([np.array(r[c], np.int32) for r in own]) for c in ("text", "meta")]
    plain = [quality.CoTraining(*whole, np.array(y, float)) for y in ([r.quality == 0 for r in own], [r.toxic == 1 for r in own])]
    for p, g in zip(plain, given, strict=True):
        assert all(p.chosen[v].tolist() == g[3][v].tolist() for v in ("text", "meta"))
    for _ in range(quality.ROUNDS):
        for t, handed in zip(plain, quality.handed_over(features, [t.models for t in plain]), strict=True):
            t.fit(handed)
    for p, name in zip(plain, ("low", "toxic"), strict=True):
        assert p.head().combine == pytest.approx(heads[name].combine)
        assert p.head().text.weights == pytest.approx(heads[name].text.weights, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_every_stage_by_itself_spares_its_workers(spark):
    """Whoever runs the stages one by one has what run() has."""
    docs = spark.createDataFrame([], ROWS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    for name, stage in corpus_pipeline.STAGES:
        for key in corpus_pipeline.WORKERS:
            spark.sparkContext.environment.pop(key, None)
        for key, value in before.items():
            spark.conf.set(key, value)
        stage(spark, docs, "/root/testdata/sf0.001")
        assert corpus_pipeline.WORKERS.items() <= spark.sparkContext.environment.items(), name
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000, name
    for key, value in before.items():
        spark.conf.set(key, value)
