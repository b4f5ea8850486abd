"""Near copies for the pipeline: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds the near links: fingerprints of the shingle sets are joined by simhash's grid of segment popcounts, and the
pairs that it finds are verified by the exact similarity. At a similarity of 0.8 fingerprints differ in ten bits and more,
which no grid can tell from chance, so what is left is completed by a prefix filter that loses no link: sets of similarity
0.8 share a shingle among the first fifth of each, in one order for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, discard, each_text, join_by_key, materialise, partitions, tidy

#: Shingle length in words, hash seed. The others change the cost and no result: the leading bits of a shingle's
#: hash under which all shingles are counted for the common order, and the rounds that link to one leader a shingle before
#: all pairs are listed.
SHINGLE_WORDS, SEED, COUNT_BITS, ROUNDS = 5, 42, 20, 2


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's word shingles (one of all words below SHINGLE_WORDS words)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + len(h)]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def histogram(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of equal ranges, about half as many as hashes, as 16-bit numbers."""
    bits = max(6, int(len(s)).bit_length() - 2)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype("<u2").tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """No fewer than the hashes that two sets share, from their histograms."""
    a, b = (np.frombuffer(h, "<u2").astype(np.int64) for h in (x, y))
    size = min(len(a), len(b))
    a, b = (h.reshape(size, -1) for h in (a, b))
    if max(a.max(), b.max()) == 65535:
        return max(a.size, b.size) * 65535  # a full range tells nothing
    return int(np.minimum(a.sum(1), b.sum(1)).sum())


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, bins, hashes) for every row of docs (doc_id, text); node is a hash of the set, fp its SimHash, bins its
    histogram. A set that its task has had before comes without the last two, so a set in very many documents is there
    once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in (batch.slice(s, 500) for s in range(0, batch.num_rows, 500)):
                nodes, fps, sets, again = [], [], [], []
                for t in each_text(part.column(1)):
                    s = shingles(t)
                    node = xxhash.xxh64_intdigest(s.tobytes(), SEED)
                    nodes.append(node)
                    fps.append(simhash.majority(s))
                    again.append(node in seen)
                    sets.append(s[:0] if again[-1] else s)
                    seen.add(node)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                hashes = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(again, pa.bool_()))
                bins = pa.array([None if a else histogram(s) for s, a in zip(sets, again, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)], bins, hashes], ["doc_id", "node", "fp", "bins", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, bins binary, hashes array<long>")


def prefix_counts(sets: DataFrame) -> np.ndarray:
    """How many of all the shingles of all sets (hashes) begin with each of the 2^COUNT_BITS leading bits. Every task counts its
    sets whole, and the tasks' counts are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            hashes = batch.column(0)
            ends = hashes.offsets.to_numpy()
            bits = hashes.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64) >> np.uint64(64 - COUNT_BITS)
            np.add.at(total, bits.astype(np.int64), 1)
        own = np.nonzero(total)[0]
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bits", "n"])

    counts = materialise(sets.select("hashes").mapInArrow(tidy(run), "bits int, n long").groupBy("bits").agg(F.sum("n").alias("n")), "copies-counts")
    counted = counts.toArrow()
    discard(counts)
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[counted["bits"].to_numpy()] = counted["n"].to_numpy()
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, node, n, k): of every set of n shingles the first n - ceil(0.8 n) + 1, k from 0, in one order for all sets:
    those with the rarest leading bits first, as counted over all sets, then by hash. Sets of similarity 0.8 share one of
    these."""
    place = np.empty(1 << COUNT_BITS, np.int32)
    place[np.argsort(prefix_counts(sets), kind="stable")] = np.arange(1 << COUNT_BITS, dtype=np.int32)
    common = sets.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = common.value
        for batch in batches:
            for part in (batch.slice(s, 500) for s in range(0, batch.num_rows, 500)):
                out = []
                hashes, nodes = part.column(1), part.column(0).to_numpy()
                ends = hashes.offsets.to_numpy()
                flat = hashes.values.to_numpy()[ends[0] : ends[-1]]
                ends = ends - ends[0]
                weight = place[(flat.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                for node, a, b in zip(nodes, ends[:-1], ends[1:], strict=True):
                    n = int(b - a)
                    if n:
                        first = np.lexsort((flat[a:b], weight[a:b]))[: n + -4 * n // 5 + 1]
                        out.append((flat[a:b][first], np.full(len(first), node), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "node", "n", "k"])

    return sets.select("node", "hashes").mapInArrow(tidy(run), "token long, node long, n int, k int")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """The rows of tokens (token, node, n, k), each once, whose token more than one node has. Rows are dealt and sorted by
    token and then stream by: a token's rows are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", "n", "k"]
        waiting = None  # the only node so far of the last token
        open_, last = None, None  # the last token if it is known to be shared, and the last node
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(4)]
            if waiting is not None:
                own = [np.concatenate([w, c]) for w, c in zip(waiting, own, strict=True)]
            if not len(own[0]):
                continue
            new = np.concatenate([[(own[0][0], own[1][0]) != (open_, last)], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])])
            own = [c[new] for c in own]
            if not len(own[0]):
                continue
            first = np.nonzero(np.concatenate([[True], own[0][1:] != own[0][:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(own[0])]]))
            several = (size > 1) | (own[0][first] == open_ if open_ is not None else False)
            waiting = None if several[-1] else [c[-1:] for c in own]
            open_, last = (own[0][-1], own[1][-1]) if several[-1] else (None, None)
            keep = np.repeat(several, size)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in own], names)

    placed = tokens.repartition(partitions(tokens.sparkSession), "token").sortWithinPartitions("token", "node")
    return placed.mapInArrow(tidy(run), "token long, node long, n int, k int")


#: SQL: x and y can have similarity 0.8, given a shingle of both that is number k of n: at most the shingles before it and
#: those after it are shared too, and 4/5 of the union must be.
CAN_MATCH = "9 * (1 + least(x.k, y.k) + least(x.n - x.k, y.n - y.k) - 1) >= 4 * (x.n + y.n)"


def possible(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose histograms in held (node, n, bins) do not rule out a similarity of 0.8: at most as many
    hashes are shared as lie in ranges of both. Histograms are a small part of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (batch.column(i) for i in (4, 5))
            keep = [9 * most_shared(x[i].as_buffer(), y[i].as_buffer()) >= 4 * int(n[i]) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    own = held.select("node", "n", "bins")
    one = pairs.join(own.toDF("a", "na", "xa").hint("merge"), "a")
    both = one.join(own.toDF("b", "nb", "xb").hint("merge"), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets in sets (node, hashes) have Jaccard similarity 0.8 or more. Only the sets that
    are asked for move; their nodes are broadcast while Spark knows them to be below its threshold, else joined by a
    shuffle."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = materialise(sets.select("node", "hashes").join(asked, "node", "left_semi").dropDuplicates(["node"]), "copies-asked")
    one = pairs.join(own.toDF("a", "ha").hint("merge"), "a")
    both = one.join(own.toDF("b", "hb").hint("merge"), "b")
    links = materialise(both.where("9 * size(array_intersect(ha, hb)) >= 4 * (size(ha) + size(hb))").select("a", "b"), "copies-links")
    discard(own)
    return links


def _pairs(x: DataFrame, y: DataFrame, apart: str) -> DataFrame:
    met = x.alias("x").join(y.alias("y").hint("merge"), F.expr("x.token = y.token")).where(f"x.root <> y.root and {apart} and {CAN_MATCH}")
    return met.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of classes (node, fp) to verify: those of one fingerprint with the smallest of it, and the smallest
    of fingerprints that simhash links."""
    lowest = classes.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    same = join_by_key(classes.select("node", "fp"), lowest, "fp", F.col("n"), classes.count()).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    name = lowest.select("fp", "low")
    edges = simhash.near_edges(lowest.select("fp"))
    near = edges.join(name.select(F.col("fp").alias("a"), F.col("low").alias("x")).hint("merge"), "a").join(name.select(F.col("fp").alias("b"), F.col("low").alias("y")).hint("merge"), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id of any type, text): documents whose word shingles have Jaccard
    similarity 0.8 or more are linked; component_id is the smallest doc_id that links reach (null ids do not count).

    No link is lost: fingerprints, and then a few rounds that compare all that hold a shingle with one leader of it, make a
    large group one component by few comparisons; then every remaining pair of different components that shares a prefix
    shingle and can match is compared. Pairs within a component need none. Equal sets are one node; null, empty and
    word-less texts are the empty set, all of one node. Repeated rows give repeated results, other columns are ignored,
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sets = materialise(shingle_sets(docs), "copies-sets")
    counted = sets.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.count("*").alias("n"))
    classes = materialise(counted.repartition(partitions(spark), "node"), "copies-classes")
    own = sets.where("hashes is not null").select("node", "hashes", "bins")
    met = materialise(shared_tokens(prefixes(own)).withColumn("root", F.col("node")), "copies-met")
    bins = own.select("node", F.size("hashes").alias("n"), "bins")
    held = materialise(bins.join(met.select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "copies-bins")
    edges = None
    for r in range(ROUNDS + 2):
        mixed = None
        if r == 0:
            pairs = fingerprint_pairs(classes)
        elif r <= ROUNDS:
            low = met.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "n", "k", "root")).alias("l"))
            pairs = _pairs(met, low.select("token", "l.node", "l.n", "l.k", "l.root"), "true")
        else:
            parts = met.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.mode("root").alias("main")).where("low <> high").select("token", "main")
            mixed = materialise(met.join(parts.hint("merge"), "token"), "copies-mixed")
            pairs = _pairs(mixed.where("root <> main"), mixed, "(y.root = y.main or x.root < y.root)")
        asked = materialise(pairs, "copies-pairs")
        left = materialise(possible(asked, held), "copies-possible")
        links = verified(left, own)
        discard(asked, left, mixed)
        edges = links if edges is None else edges.unionByName(links)
        if r <= ROUNDS and not links.isEmpty():
            roots = materialise(connected_components(edges), "copies-roots")
            relabelled = met.drop("root").join(roots.hint("merge"), "node", "left").select("token", "node", "n", "k", F.coalesce("root", "node").alias("root"))
            last, met = met, materialise(relabelled, "copies-met")
            discard(last, roots)
    by_class = simhash.component_ids(classes, "node", edges)
    discard(held, met, classes)
    nodes = materialise(sets.select("doc_id", "node"), "copies-nodes")
    discard(sets)
    return join_by_key(nodes, by_class, "node", F.col("n"), nodes.count()).select("doc_id", "component_id")
