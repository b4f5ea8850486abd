"""SimHash, embeddings and archives against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tradelake.llm import embedding_dedup, hnsw, simhash, warc
from tradelake.llm.common import connected_components

from .conftest import ODD


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, ["a", "b"])).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert {i: got.get(i, i) for i in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = components(range(len(rows)), near)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[root[i]] = min(lowest.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), format(fps[i], "016x"), str(lowest.get(root[i]))) for i, r in enumerate(rows))


def test_simhash(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain_simhash(ODD)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema


def test_links_of_all_distances(spark):
    """Fingerprints a few flips apart: links are those at distance 2 or less and no others."""
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(6)}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in signed], "fp long"))
    links = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert components(signed, links) == components(signed, near)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text + " tail", 2), (9, text, 3), (1, "something else entirely here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(groups.values())
    assert groups[5] == groups[9] and groups[1] == 1


def clustered(seed, n=900, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    v = [centres[i % 12] + 0.12 * rng.standard_normal(dim) * (i % 3) for i in range(n // 2)] + list(rng.standard_normal((n // 4, dim)))
    v += [v[int(rng.integers(len(v)))] * rng.choice([0.5, 1, 3]) for _ in range(n - len(v))]
    return [(i * 3 + 1, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def test_embeddings_against_brute_force(spark):
    rows = clustered(4)
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None, *[1.0] * 23]), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in rows]
    found = sum(got[i].n_links for i in ids)
    assert found <= hit.sum() and found >= 0.98 * hit.sum() and all(got[i].n_links <= h for i, h in zip(ids, hit.sum(1), strict=True))
    root = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True) if a < b])
    assert np.mean([got[i].component_id == root[i] for i in ids]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(5000, 5005))
    assert (got[5005].n_links, got[5006].component_id) == (1, 5005)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(16)
    for s in range(0, len(x), hnsw.BATCH):
        g.add(x[s : s + hnsw.BATCH])
    q = rng.standard_normal((300, 16)).astype(np.float32)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :5]
    recall = [np.mean([len(set(t) & set(f)) / 5 for t, f in zip(truth.tolist(), g.search(q, w)[1].tolist(), strict=True)]) for w in (8, 128)]
    assert recall[1] > 0.95 and recall[1] >= recall[0]


def test_spanning_edges_connect_what_is_hit():
    rng = np.random.default_rng(1)
    hit = rng.random((30, 40)) < 0.04
    left, right = np.arange(100, 130), np.arange(200, 240)
    pairs = [(left[a], right[b]) for a, b in zip(*np.nonzero(hit), strict=True)]
    edges = [(a, b) for node, root in embedding_dedup._spanning(left, right, hit) for a, b in zip(node, root, strict=True)]
    everything = [*left, *right]
    assert components(everything, edges) == components(everything, pairs) and len(edges) <= 70


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 9000])
def test_chunked_framing(size):
    payload = random.Random(size).randbytes(size)
    assert warc.unchunked(warc.chunked(payload)) == payload
    if size > 1:
        with pytest.raises((ValueError, IndexError)):
            warc.unchunked(warc.chunked(payload)[: size // 2])


def pages():
    rnd = random.Random(7)
    big = "".join(rnd.choices("abcé漢\r\n ", k=90_000))
    same = "<html>" + "s" * 2000
    return [(1, "http://a/", same), (2, "http://b/", same), (5, None, same), (5, None, same), (3, "u\r\nv", big), (4, "http://c/", None), (6, "http://d/", ""), (7, "x", "short"), (8, "y", "short"), (9, "z", "WARC/1.1\r\n\r\n" * 500), (None, "n", same)]


def test_archives_round_trip(spark):
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i != top.get(h) and sum(r[2] == h for r in rows) > 1
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(top[h] if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted((h or "").encode() for (i, _, h), w in zip(rows, want, strict=True) if w[3] == "response")


def test_long_records_are_continued(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages()[4:5], "page_id long, url string, html string"), str(tmp_path / "w"))
    segments = warc.read_segments(spark, str(tmp_path / "w")).collect()
    assert sorted(s.number for s in segments) == list(range(1, len(segments) + 1)) and len(segments) > 2
    assert len({s.origin for s in segments}) == 1 and [s.total for s in segments if s.number == len(segments)] == [sum(len(s.block) for s in segments)]


def test_a_lost_segment_is_an_error(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages()[4:5], "page_id long, url string, html string"), str(tmp_path / "w"))
    segments = warc.read_segments(spark, str(tmp_path / "w"))
    for gone in ("number = 2", "total is not null"):
        with pytest.raises(Exception, match="missing|differs"):
            warc.reassemble(segments.where(f"not coalesce({gone}, false)")).collect()


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
