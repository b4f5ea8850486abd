"""Embedding near-dedup: a small-world graph per shard, every shard searched, cosine verified, components united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, connected_components, join_by_key, materialise, with_long_id
from .hnsw import BATCH, BUILD_BEAM, Graph

#: Cosine from which on vectors are linked; cosine to its leader from which on a vector is kept in the leader's list.
THRESHOLD, LEADER = 0.95, 0.98
#: Bytes of a shard's vectors (about; 8 a component), and shards at least.
SHARD_BYTES, LEAST_SHARDS = 1 << 25, 8
#: Share of the audited links, and of turned leaders, that a beam must find, the first beam, audit queries of a shard (stored
#: ones, and again foreign ones), and the cosine of turned leaders.
RECALL, FIRST_BEAM, AUDITS, AUDIT_COSINE = 0.98, 16, 200, 0.88
_CELLS = 1 << 21


class Shard:
    """Vectors of a shard under leaders: the graph holds the leaders, and each leader a list of the vectors within
    LEADER of it, so that a large group of near copies is a few nodes. A vector within THRESHOLD of a query lies
    under a leader within the sum of both angles of it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray):
        self.ids, self.vectors, self.weights = ids, vectors, weights
        self.links = np.zeros(len(ids), np.int64)
        self.graph = Graph(vectors.shape[1])
        self.reach = float(np.cos(np.arccos(THRESHOLD) + np.arccos(LEADER)))
        leader_of = np.full(len(ids), -1, np.int64)
        for s in range(0, len(ids), BATCH):
            self._insert(np.arange(s, min(s + BATCH, len(ids))), leader_of)
        order = np.argsort(leader_of, kind="stable")
        cuts = np.searchsorted(leader_of[order], np.arange(len(self.graph) + 1))
        self.members = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.leader_of = leader_of
        self.width = FIRST_BEAM
        self._audit_turned()
        own = np.random.default_rng(12).choice(len(ids), min(len(ids), AUDITS), replace=False)
        self.audit_links(vectors[own], ids[own])
        self.strangers = AUDITS  # foreign queries that are still to be audited

    def _insert(self, rows: np.ndarray, leader_of: np.ndarray) -> None:
        own, near = self.vectors[rows].astype(np.float32), None
        if len(self.graph):
            sims, found = self.graph.search(own, BUILD_BEAM)
            joins = sims[:, 0] >= LEADER
            leader_of[rows[joins]] = found[joins, 0]
            rows, own, near = rows[~joins], own[~joins], (sims[~joins], found[~joins])
        among = own @ own.T >= LEADER
        lead = np.full(len(rows), -1, np.int64)
        fresh = []
        for i in range(len(rows)):
            earlier = np.nonzero(among[i, fresh])[0] if fresh else ()
            lead[i] = earlier[0] if len(earlier) else len(fresh)
            if not len(earlier):
                fresh.append(i)
        leader_of[rows] = lead + len(self.graph)
        if fresh:
            self.graph.add(own[fresh], near and tuple(x[fresh] for x in near))

    def _audit_turned(self) -> None:
        """Widen the beam until it finds RECALL of leaders that noise has turned to AUDIT_COSINE."""
        n = len(self.graph)
        rng = np.random.default_rng(11)
        own = rng.choice(n, min(n, AUDITS), replace=False)
        noise = rng.standard_normal((len(own), self.vectors.shape[1])).astype(np.float32)
        base = self.graph.vectors[own]
        noise -= np.einsum("qd,qd->q", noise, base)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
        queries = AUDIT_COSINE * base + np.sqrt(1 - AUDIT_COSINE**2) * noise
        while self.width < n:
            _, found = self.graph.search(queries, self.width)
            if (found == own[:, None]).any(1).mean() >= RECALL:
                return
            self.width *= 2

    def audit_links(self, queries: np.ndarray, ids: np.ndarray) -> None:
        """Widen the beam until it finds RECALL of the links that brute force finds between the queries and the shard."""
        want = []
        step = max(1, _CELLS // max(1, len(queries)))
        for s in range(0, len(self.ids), step):
            rows, cols = np.nonzero(queries @ self.vectors[s : s + step].T >= THRESHOLD)
            other = ids[rows] != self.ids[s + cols]
            want.append(rows[other] * len(self.graph) + self.leader_of[s + cols[other]])
        want = np.concatenate([*want, np.zeros(0, np.int64)])
        while len(want) and self.width < len(self.graph):
            rows, leaders = self.leaders_near(queries)
            if np.isin(want, rows * len(self.graph) + leaders).mean() >= RECALL:
                return
            self.width *= 2

    def leaders_near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leader) pairs within reach; the beam of a query that is full of such leaders is widened."""
        out, todo, width = [], np.arange(len(queries)), self.width
        q32 = queries.astype(np.float32)
        while len(todo):
            sims, found = self.graph.search(q32[todo], width)
            full = (sims[:, -1] >= self.reach) & (width < len(self.graph))
            rows, cols = np.nonzero((sims >= self.reach - 1e-5) & ~full[:, None])
            out.append((todo[rows], found[rows, cols]))
            todo, width = todo[full], width * 2
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def match(self, ids: np.ndarray, queries: np.ndarray, weights: np.ndarray, own: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Links of each query to this shard's vectors (copies count by weight), and edges that connect what is linked.
        Links of the shard's vectors to foreign queries are added to self.links."""
        links, edges = np.zeros(len(ids), np.int64), []
        if not own and self.strangers:
            some = min(self.strangers, len(ids))
            self.audit_links(queries[:some], ids[:some])
            self.strangers -= some
        for s in range(0, len(ids), BATCH):
            which, leaders = self.leaders_near(queries[s : s + BATCH])
            order = np.argsort(leaders, kind="stable")
            which, leaders = which[order] + s, leaders[order]
            cuts = [0, *(np.nonzero(leaders[1:] != leaders[:-1])[0] + 1).tolist(), len(leaders)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                rows, members = which[a:b], self.members[leaders[a]]
                step = max(1, _CELLS // len(rows))
                for m in range(0, len(members), step):
                    cols = members[m : m + step]
                    hit = queries[rows] @ self.vectors[cols].T >= THRESHOLD
                    if own:
                        hit &= ids[rows][:, None] != self.ids[cols][None, :]
                    links[rows] += hit @ self.weights[cols]
                    if not own:
                        self.links[cols] += weights[rows] @ hit
                    edges += _spanning(ids[rows], self.ids[cols], hit)
        return links, edges


def _spanning(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (node, smallest id of its component) of the graph that hit draws between left and right: as many as
    nodes and not as pairs."""
    rows, cols = hit.any(1), hit.any(0)
    if not rows.any():
        return []
    left, right, hit = left[rows], right[cols], hit[np.ix_(rows, cols)]
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(hit, b[None, :], big).min(1))
        b2 = np.minimum(b, np.where(hit, a2[:, None], big).min(0))
        if (a2 == a).all() and (b2 == b).all():
            return [(left, a), (right, b)]
        a, b = a2, b2


def usable(column: str = "embedding") -> str:
    """SQL: the vector has only finite components and is not zero."""
    return f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists({column}, x -> x <> 0)"


def near_links(classes: DataFrame) -> DataFrame:
    """(node, links, root): for each distinct vector (id, embedding, weight) rows whose links sum up to the weight of
    the vectors linked to it, and rows with an edge to root (else null).

    Vectors of one length are dealt by hash into shards of about SHARD_BYTES, and each pair of shards meets once: the
    vectors of one are sought in the graph of the other."""
    sized = classes.withColumn("size", F.size("embedding"))
    shards = F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") * F.col("size") * 8 / SHARD_BYTES)).cast("int").alias("shards")
    sizes = sized.groupBy("size").agg(F.count("*").alias("n")).select("size", shards)
    total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    # shards are numbered over all lengths, and each is a task of its own: two of them in one would take twice as long
    numbered = sizes.withColumn("first", (F.sum("shards").over(Window.orderBy("size")) - F.col("shards")).cast("int"))
    base = sized.join(numbered, "size").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    # a shard is sought in the half of the others that follows it in a ring
    half = F.expr("filter(transform(sequence(1, int(shards / 2)), d -> struct((shard + d) % shards as to, d)), x -> 2 * x.d < shards or shard < x.to)")
    asked = base.withColumn("to", F.explode(half)).select("size", F.col("to.to").alias("shard"), F.lit(1).alias("role"), "id", "embedding", "weight", "first")
    rows = base.select("size", "shard", F.lit(0).alias("role"), "id", "embedding", "weight", "first").unionByName(asked)
    placed = rows.repartitionById(max(1, int(total)), (F.col("first") + F.col("shard")).cast("int")).drop("first").sortWithinPartitions("size", "shard", "role", "id")

    def out(node: np.ndarray, links: np.ndarray, root: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.nulls(len(node), pa.int64()) if root is None else pa.array(root, pa.int64())], ["node", "links", "root"])

    def edges(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            node, root = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([node, root])[:, node != root], axis=1)
            yield out(pairs[0], np.zeros(pairs.shape[1], np.int64), pairs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, its own vectors first: these are indexed, and then the queries stream by."""
        number, held, shard = None, [], None

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held
            ids, vectors, weights = (np.concatenate(x) for x in zip(*held, strict=True))
            held, shard = [], Shard(ids, vectors, weights)
            links, found = shard.match(ids, vectors, weights, own=True)
            yield out(ids, links + weights - 1, None)
            yield from edges(found)

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                yield from built()
            if shard is not None:
                some = shard.links > 0
                yield out(shard.ids[some], shard.links[some], None)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, where, role = batch.slice(a, b - a), tuple(keys[a, :2].tolist()), int(keys[a, 2])
                if number != where:
                    yield from closed()
                    number, held, shard = where, [], None
                ids, weights = part.column(3).to_numpy(), part.column(5).to_numpy()
                flat = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                # scaled first: squares of very large or small components would overflow or vanish
                flat = flat / np.abs(flat).max(1, keepdims=True)
                flat /= np.linalg.norm(flat, axis=1, keepdims=True)
                if role == 0:
                    held.append((ids, flat, weights))
                    continue
                if held:
                    yield from built()
                if shard is not None:
                    links, found = shard.match(ids, flat, weights, own=False)
                    some = links > 0
                    yield out(ids[some], links[some], None)
                    yield from edges(found)
        yield from closed()

    return placed.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id of any type, embedding).

    Vectors are linked at a cosine, in double precision, of 0.95 or more, ties included; those that are null, empty, zero, or
    hold a null or non-finite component link with nothing. Vectors of different lengths are never compared. n_links counts
    the other rows that were found linked to a row, component_id is the smallest vec_id that links reach, and kept
    says whether that is the row itself. Equal vectors (by 128 bits of hash) are one node with a weight; repeated rows link to
    each other. A null vec_id names no component: such a row counts as a link of others with its vector's weight, and its own
    component_id is that of its vector, null if there is none. Other columns are ignored, whatever their names; an empty table
    gives an empty result. Every vector is indexed; the graphs may miss some links (see the README for the recall), and none
    is made up.
    """
    kind = vectors.schema["vec_id"].dataType
    own = with_long_id(vectors.select("vec_id", "embedding"), "own", "vec_id")
    doubles = F.col("embedding").cast("array<double>")
    key = F.when(F.expr(usable()), F.concat(F.hex(F.xxhash64(doubles)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), doubles))))
    rows = own.select("vec_id", "own", "embedding", key.alias("key"))
    named = F.col("own") != NULL_ID
    grouped = rows.where("key is not null").groupBy("key").agg(F.min(F.when(named, F.col("own"))).alias("id"), F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
    classes = materialise(grouped, "vector-classes")
    found = materialise(near_links(classes.where("id is not null").select("id", "embedding", "weight")), "vector-links")
    links = found.where("root is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found.where("root is not null"), "node", "root")
    joined = classes.drop("embedding").join(links.hint("merge"), F.col("id") == links.node, "left").drop("node").join(roots.hint("merge"), F.col("id") == roots.node, "left").drop("node")
    labelled = joined.select("key", "first", "weight", F.coalesce("n_links", F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    known = join_by_key(labelled.where("root is not null"), lowest, "root", F.col("size"), classes.count()).select("key", "weight", "n", "component")
    nameless = labelled.where("root is null").select("key", "weight", "n", F.lit(None).cast(kind).alias("component"))
    by_key = materialise(known.unionByName(nameless), "vector-components")
    good = join_by_key(rows.where("key is not null").select("vec_id", "key"), by_key, "key", F.col("weight"), rows.count()).select("vec_id", "n", "component")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    component = F.coalesce("component", "vec_id")
    return good.unionByName(alone).select("vec_id", F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
