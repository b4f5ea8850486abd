"""Collocations, centroids and packing against plain versions, and their odd rows."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradelake.llm import centroids, collocations, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- phrases ----
def plain_phrases(rows, top, least, longest, percent):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    ends, lower = dict.fromkeys(map(ord, ".,;:!?\n\x0b\x0c\r"), "\n"), {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        for piece in (text or "").translate(lower | ends).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {p[i:j] for p, a in good.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * counts[p[i:j]]}
        scored = []
        for p, a in good.items():
            if p not in inner:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "é", "漢字", "x\x00y", "n", "The", "of", "zz"]
    text = lambda: "".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice([" "] * 12 + [", ", "\n", "\t", "  ", " ", "?!", "\x0b"]) for _ in range(rng.randint(0, 120)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([text(), text(), "New York City hall is big. " * 3])) for _ in range(160)]
    return rows + [("en", None), ("fr", ""), ("fr", " ,\n"), (None, None), ("en", "word " * 4000)]


@pytest.mark.parametrize(("top", "least", "longest", "percent", "batch"), [(2000, 5, 5, 100, 200_000), (7, 3, 4, 60, 40)])
def test_phrases(spark, monkeypatch, spoken, top, least, longest, percent, batch):
    monkeypatch.setattr(collocations, "STEP", 500)
    monkeypatch.setattr(collocations, "WORDS", 6)
    monkeypatch.setattr(collocations, "GATHERED", 40)
    docs = spark.createDataFrame([(*r, 1, "x") for r in spoken], "lang string, text string, f int, phrase string").repartition(3)
    got = sorted(map(tuple, collocations.mine(docs, top, least, longest, percent, batch).collect()))
    assert got == plain_phrases(spoken, top, least, longest, percent) and len(got) > 5


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0


def test_scores_past_64_bits(spark):
    """Products of counts that only decimals hold."""
    big = 10**15
    found = spark.createDataFrame([("en", "a b c", 3, big, [7 * big, 3 * big])], "lang string, phrase string, m int, f long, pre array<long>")
    found = found.withColumn("pre", F.concat("pre", F.array("f")))
    known = spark.createDataFrame([("en", "b c", 2 * big + 1), ("en", "c", 5 * big)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 90 * big)], "lang string, n long")
    cut = collocations.lowest_cut(found, known, totals).first().cut
    want = min((1000 * big * 90 * big // (le * r), k, le, r) for k, le, r in ((1, 7 * big, 2 * big + 1), (2, 3 * big, 5 * big)))
    assert tuple(cut) == want


# ---- centroids ----
def plain_clusters(rows, clusters, rounds, size, scale=64, seed=1):
    kept = [(i, [math.floor(v * scale) if abs(v) < 2**50 else int(v) * scale for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    now = [e for _, e in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(e, c), k) for k, c in enumerate(now)) for _, e in kept]
    for _ in range(rounds):
        own = assign()
        for k in range(len(now)):
            mine = [e for (_, e), (_, c) in zip(kept, own, strict=True) if c == k]
            if mine:
                now[k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    own = assign()
    fits = lambda v: v if v is not None and v < 2**63 else None
    total = lambda ds: None if any(d >= 2**63 for d in ds) else fits(sum(ds))
    each = {k: total([d for d, c in own if c == k]) for k in range(len(now))}
    whole = total([d for d, _ in own])
    return sorted(((i, k, fits(d), each[k], whole, sha256(",".join(map(str, now[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, own, strict=True)), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(5, 4)) * 3
    rows = [(i, (middle[i % 5] + rng.normal(size=4) * 0.3).round(2).tolist()) for i in range(150)]
    rows += [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(200, 240)]  # ties
    return rows + [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0, 4.0]), (301, None), (302, []), (303, [1.0, None, 1.0, 1.0]), (304, [math.inf, 0.0, 0.0, 0.0]), (305, [math.nan] * 4), (306, [1.0] * 5), (307, [0.0] * 4), (308, [-0.0] * 4)]


@pytest.mark.parametrize(("kind", "clusters"), [("double", 6), ("float", 16), ("double", 500)])
def test_clusters(spark, vectors, kind, clusters):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.lit(1).alias("cluster"), F.lit(2).alias("distance"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, centroids.cluster(df.repartition(4), clusters, 3, 4).collect()), key=str)
    assert got == plain_clusters(rows, clusters, 3, 4)


def test_clusters_of_huge_numbers(spark, vectors):
    """Components whose squares no 64 bits hold, and some that no double holds once scaled."""
    rows = [*vectors[:40], (900, [1e300, -1e300, 0.0, 1.0]), (901, [1.7e308, 0.0, 0.0, 0.0]), (902, [1e9, 1e9, -1e9, 3.5]), (903, [1e9, 1e9, -1e9, 4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, 5, 3, 4).collect()), key=str)
    assert got == plain_clusters(rows, 5, 3, 4)


def test_bounds_spare_distances_and_hold():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 64)) * 400
    x = (middle[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 64)) * 20).astype(np.int64)
    cs = [list(map(int, c)) for c in middle]
    pivots = cs[:6]
    far = np.array([np.sqrt(centroids.squared(x, p).astype(float)) for p in pivots]).T
    low = centroids.bounds(far, cs, pivots)
    exact = np.array([centroids.squared(x, c) for c in cs]).T
    assert (low <= exact).all()
    number, distance, done = centroids.nearest(x, far, cs, pivots)
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all() and done < 0.4 * exact.size


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).count() == centroids.cluster(df.where("false")).count() == 0
    named = spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64), (None, [2.0] * 64)], "vec_id string, embedding array<double>")
    assert {(r.vec_id, r.distance) for r in centroids.cluster(named).collect()} == {("a", 0), ("b", 0), (None, 0)}


# ---- packing ----
def checked(docs, pieces, length):
    """Every document's ids in order, sequences without gaps, no padding."""
    library = Tokenizer.from_file(WORDS)
    rows, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        rows[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs}
    copies = Counter(r.doc_id for r in docs)
    assert set(rows) == set(want)
    for i, own in rows.items():
        held = Counter()
        for p in own:
            ids = np.frombuffer(p.ids, "<u4").tolist()
            assert len(ids) == p.length > 0 and ids == want[i][p.start : p.start + p.length] and p.doc_tokens == len(want[i])
            held.update(range(p.start, p.start + p.length))
        assert held == Counter({k: copies[i] for k in range(len(want[i]))})
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or at < length and at & (at - 1) == 0
    return sequences


def test_packing(spark, odd, monkeypatch):
    more = [(100 + i, t, "en", "a", 1, 1, "r", 2) for i, t in enumerate(["<|ENDOFTEXT|> Ab", "İx Å \u0085a b c é, don't 12ab3 ΣΑΣ Σ.", "a,,b (x),  It's", "x" * 70000, "<|startoftext|>word<|endoftext|>", "​­﻿", "é e ́"])]
    docs = odd.where("doc_id is not null").unionByName(spark.createDataFrame(more, odd.schema)).withColumns({"key": F.lit(1), "salt": F.lit(2), "start": F.lit(3)})
    for length, cache in ((64, 600_000), (4096, 3)):
        monkeypatch.setattr(packing, "CACHE_WORDS", cache)
        monkeypatch.setattr(packing, "STEP", 2000)
        pieces = packing.pack(docs, WORDS, length)
        sequences = checked(docs.collect(), pieces.collect(), length)
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack(docs, WORDS, 64)).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(p.length for own in sequences.values() for p in own)
    assert all(len(r.ids) == sum(p.length for p in r.pieces) for r in whole.values())


def test_packing_text_ids_and_nothing(spark, odd, nothing):
    named = odd.withColumn("doc_id", F.format_string("d%d", "doc_id"))
    assert packing.pack(named, WORDS).count() == packing.pack(odd, WORDS).count() > 10
    assert packing.pack(nothing, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_hilbert_neighbours(monkeypatch):
    """The curve goes through every cell once, each next to the one before."""
    monkeypatch.setattr(packing, "BITS", 3)
    for d in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(8)] * d), -1).reshape(-1, d)
        keys = packing.hilbert(cells)
        assert sorted(keys.tolist()) == list(range(8**d))
        assert (np.abs(np.diff(cells[keys.argsort()], axis=0)).sum(1) == 1).all()


def test_projection_of_long_and_short_texts():
    texts = [b"", b"abc", b"The same text again", b"the SAME text again", b"xy" * 100_000, b"other words, other grams"]
    ends = np.cumsum([0, *map(len, texts)])
    got = packing.projected(np.frombuffer(b"".join(texts), np.uint8), ends)
    alone = [packing.projected(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    assert (got == np.concatenate(alone)).all() and (got[2] == got[3]).all() and (got[2] != got[5]).any() and not got[:2].any()


def test_similar_texts_share_a_sequence(spark):
    rng = random.Random(9)
    topics = [[f"{chr(97 + t)}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)] for t in range(4)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(topics[i % 4]) for _ in range(150)), "x") for i in range(80)], "doc_id int, text string, lang string").repartition(5)
    own = defaultdict(Counter)
    for p in packing.pack(docs, WORDS, 1024).collect():
        own[p.sequence_id][p.doc_id % 4] += p.length
    pure = sum(max(c.values()) for c in own.values()) / sum(sum(c.values()) for c in own.values())
    assert pure > 0.6  # 0.25 and a little more if documents came in any order
