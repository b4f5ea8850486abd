"""The pipeline's near-copy stage against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tradelake.llm import near_copies

from .conftest import ODD
from .test_near_duplicates import components


def plain_components(rows):
    """component_id by row, from the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x == y or 5 * len(x & y) >= 4 * len(x | y)]
    root = components(range(len(rows)), pairs)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[root[i]] = min(lowest.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), str(lowest.get(root[i]))) for i, r in enumerate(rows))


def edited(seed):
    """Texts with edits of 0 to 8 % of the words of one hot and some small groups, around a shared passage."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 40, 150, 400]))]
        for _ in range(60 if g == 0 else 8):
            words = list(base)
            for _ in range(rnd.randrange(1 + max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join((words + passage if rnd.random() < 0.5 else words)[rnd.randrange(3) :])))
    return rows


def got(spark, docs):
    return sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs).collect())


def test_components_are_those_of_all_pairs(spark, odd, nothing):
    assert got(spark, odd) == plain_components(ODD)
    assert near_copies.near_copies(nothing).count() == 0
    rows = edited(3)
    want = plain_components(rows)
    assert 12 < len({c for _, c in want}) < len(rows)
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_histograms_never_rule_out_what_is_shared():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 60, 400, 3000):
        x = np.unique(rnd.integers(0, 2**64, n, np.uint64))
        for part in (0.5, 0.9, 1):
            y = np.unique(np.concatenate([x[rnd.random(len(x)) < part], rnd.integers(0, 2**64, n // 8 + 1, np.uint64)]))
            bound = near_copies.most_shared(near_copies.histogram(x), near_copies.histogram(y))
            assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_stage_drops_a_copy_with_a_word_in_sixty_changed(spark):
    words = [f"w{i}" for i in range(240)]
    near = ["x" if i % 60 == 30 else w for i, w in enumerate(words)]
    far = ["x" if i % 10 == 5 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([words, near, far])], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]
