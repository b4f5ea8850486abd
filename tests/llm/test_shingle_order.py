import numpy as np
from pyspark.sql import functions as F

from tradelake.llm import near_copies


def test_every_set_counts_for_the_order(spark):
    # far more sets than a sample held; the last one alone has a shingle that the others lack
    common, rare = 7 << 44, 9 << 44
    sets = spark.range(20_000).select("id", F.array(F.lit(common)).alias("hashes"))
    sets = sets.unionByName(spark.range(1).select("id", F.array(F.lit(common), F.lit(rare), F.lit(rare + 1)).alias("hashes")))
    counts = near_copies.prefix_counts(sets)
    assert counts.sum() == 20_003 and counts[7] == 20_001 and counts[9] == 2


def test_rarest_shingles_come_first(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["one two three four five six", *map(str, rng.integers(0, 10**9, 4))]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_copies.shingle_sets(docs).where("hashes is not null").select("node", "hashes")
    shared = {int(h) - (1 << 64 if int(h) >= 1 << 63 else 0) for h in near_copies.shingles(b"one two three four five six")}
    rows = near_copies.prefixes(sets).collect()
    assert {r.node for r in rows} == {r.node for r in sets.collect()}
    assert not any(r.token in shared for r in rows)


def test_workers_of_the_pipeline_return_memory(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []

    def names(batches):
        import os

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"name": [f"{k}={os.environ.get(k)}" for k in sorted(corpus_pipeline.WORKERS)]})

    def stage(s, docs, d):
        seen.extend(r.name for r in docs.select("doc_id").mapInArrow(names, "name string").collect())
        return docs

    monkeypatch.setattr(spark.sparkContext, "environment", dict(spark.sparkContext.environment))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(seen) == {f"{k}={v}" for k, v in corpus_pipeline.WORKERS.items()}
