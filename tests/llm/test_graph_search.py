"""Graphs of vectors that lie far apart: narrow beams find what is near, and each shard is a task of its own."""

import numpy as np
from pyspark.sql import functions as F

from tradelake.llm import embedding_dedup, hnsw


def random_units(n, dim=64, seed=3):
    v = np.random.default_rng(seed).standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_a_narrow_beam_is_enough_for_vectors_without_structure():
    v = random_units(6400)
    shard = embedding_dedup.Shard(np.arange(6400), v, np.ones(6400, np.int64))
    assert shard.width == 16
    near = v[:500] + 0.03 * np.random.default_rng(4).standard_normal((500, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    links, _ = shard.match(np.arange(10000, 10500), near, np.ones(500, np.int64), own=False)
    hits = (near @ v.T >= embedding_dedup.THRESHOLD).sum(1)
    assert (links <= hits).all() and links.sum() >= 0.98 * hits.sum() > 400


def test_a_beam_holds_each_node_once_and_the_nearest_first():
    v = random_units(1500, 16).astype(np.float32)
    graph = hnsw.Graph(16)
    for s in range(0, len(v), hnsw.BATCH):
        graph.add(v[s : s + hnsw.BATCH])
    queries = random_units(300, 16, 5).astype(np.float32)
    sims, ids = graph.search(queries, 40)
    assert all(len(set(r.tolist())) == 40 for r in ids) and (np.diff(sims, axis=1) <= 0).all()
    assert np.abs(sims - np.einsum("qd,qkd->qk", queries, v[ids])).max() < 1e-6
    best = np.argsort(-(queries @ v.T), axis=1)[:, :10]
    assert np.mean([np.isin(b, i).mean() for b, i in zip(best, ids, strict=True)]) > 0.95
    few = hnsw.Graph(16)
    few.add(v[:3])
    sims, ids = few.search(queries, 40)
    assert sims.shape[1] == 3 and (np.sort(ids, axis=1) == [0, 1, 2]).all()


def test_each_shard_is_a_task(spark):
    rows = [(i, x.tolist(), 1) for i, x in enumerate(random_units(400, 8))] + [(1000 + i, x.tolist(), 1) for i, x in enumerate(random_units(400, 12))]
    found = embedding_dedup.near_links(spark.createDataFrame(rows, "id long, embedding array<float>, weight long"))
    tasks = found.where("root is null").select("node", F.spark_partition_id().alias("task")).groupBy("task").agg(F.countDistinct("node").alias("n")).collect()
    assert len(tasks) == 2 * embedding_dedup.LEAST_SHARDS and sum(r.n for r in tasks) >= 800
