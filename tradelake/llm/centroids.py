"""Centroid clustering of integer vectors: Ptolemaic lower bounds over fixed pivot pairs, survivors checked exactly.

Ptolemy's inequality holds in Euclidean space: d(x,p) d(c,q) and d(x,q) d(c,p) differ by at most d(x,c) d(p,q). Distances of every
vector to the pivots are stored once; a round only measures the centroids against the pivots and then bounds all distances
from below. All sums and distances are whole numbers, so the order of rows and tasks changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

#: Integers up to this size are computed with 64 bits (64 squares of twice this fit), larger ones without a limit.
NARROW = 1 << 27
#: Room for the rounding of a bound: products, square roots and quotients of doubles are off by far less than this share.
SLACK = 2.0**-44
#: Sums leave a task in base 10 ** LIMB, so that whole numbers of any size can be added up in decimals.
LIMB = 15
LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly, as 64-bit or as Python integers; x as doubles."""
    top = float(np.abs(x).max(initial=0.0))
    if top * scale <= NARROW:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return out


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Squared distances of the rows of x to c: 64-bit integers, or Python integers where these could overflow."""
    if x.dtype != object and max(map(abs, c)) <= NARROW:
        d = x - np.array(c, np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - np.array(c, object)
    return (d * d).sum(1)


def root(v: int) -> float:
    """The square root of a whole number of any size."""
    return math.sqrt(v) if v < 1 << 1000 else math.inf


def bounds(to_pivots: np.ndarray, centroids: list[list[int]], pivots: list[list[int]]) -> np.ndarray:
    """(rows, centroids): no more than the squared distances, by the best pivot pair. to_pivots: distances (rows, pivots)."""
    own = np.array([[root(sum((a - b) ** 2 for a, b in zip(c, p, strict=True))) for p in pivots] for c in centroids])
    best = np.zeros((len(to_pivots), len(centroids)))
    with np.errstate(all="ignore"):
        for i, j in combinations(range(len(pivots)), 2):
            apart = root(sum((a - b) ** 2 for a, b in zip(pivots[i], pivots[j], strict=True)))
            if not 0 < apart < math.inf:
                continue
            x, y = to_pivots[:, i, None] * own[None, :, j], to_pivots[:, j, None] * own[None, :, i]
            low = (np.abs(x - y) - SLACK * (x + y)) / apart
            best = np.fmax(best, low)  # what overflowed is no number, and bounds nothing
        best = best * best * (1 - SLACK)
    return np.where(np.isfinite(best), best, 0)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: list[list[int]], pivots: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row, ties to the smaller number, and how many distances were
    computed. The centroid with the least bound is measured first; others only where their bound does not exceed that."""
    low = bounds(to_pivots, centroids, pivots)
    number = low.argmin(1)
    exact = object if x.dtype == object or any(abs(v) > NARROW for c in centroids for v in c) else np.int64
    distance = np.zeros(len(x), exact)
    for c in np.unique(number):
        own = number == c
        distance[own] = squared(x[own], centroids[c])
    first, done = number.copy(), len(x)
    for c in range(len(centroids)):
        near = np.nonzero((first != c) & (low[:, c] <= distance.astype(float)))[0] if exact is np.int64 else np.nonzero(first != c)[0]
        if not len(near):
            continue
        done += len(near)
        d = squared(x[near], centroids[c])
        better = (d < distance[near]) | ((d == distance[near]) & (c < number[near]))
        distance[near[better]], number[near[better]] = d[better], c
    return number, distance, done


def limbs(v: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of v in base 10 ** LIMB; the last digit has the sign."""
    place, base = 0, 10**LIMB
    while abs(v) >= base:
        v, digit = divmod(v, base)
        yield place, digit
        place += 1
    yield place, v


def _points(batch: pa.RecordBatch, size: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of column 1 are whole vectors, and of these the doubles and the integers."""
    column = batch.column(1)
    values = column.values.cast(pa.float64())
    ends = column.offsets.to_numpy().astype(np.int64)
    right = (np.diff(ends) == size) & column.is_valid().to_numpy(zero_copy_only=False)
    at = ends[:-1][right][:, None] + np.arange(size)
    flat = values.to_numpy(zero_copy_only=False)
    x = flat[at] if len(at) else np.zeros((0, size))
    fine = np.isfinite(x).all(1) & (values.is_valid().to_numpy(zero_copy_only=False)[at].all(1) if len(at) else np.zeros(0, bool))
    right[np.nonzero(right)[0][~fine]] = False
    return right, x[fine], whole(x[fine], scale)


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, pivots: int = 6) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for the rows of vectors (vec_id of any type,
    embedding) that have exactly size components, none null or non-finite; other rows go. A component x is the integer
    floor(scale * x).

    Centroids 0, 1, ... start as the vectors with the smallest sha256 of "<seed>:<vec_id>", in that order (then by components;
    null ids last); with fewer vectors there are fewer. Each round assigns every vector to the nearest centroid (ties: the
    smaller number) and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once more.
    Repeated rows count each by itself. An empty table gives an empty result. A distance, or a sum of distances, that does not
    fit 64 bits is null; assignments stay exact. Other columns are ignored, whatever their names.

    Vectors stay where they are: a round sends the centroids out and brings sums back, at most clusters x (size + 1) numbers
    a task, added up in decimals before the driver gets them. The pivots are the first of the starting centroids, for all rounds.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    item = vectors.schema["embedding"].dataType.elementType
    embedding = F.col("embedding") if isinstance(item, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    held = f"vec_id {kind}, embedding array<{item.simpleString() if isinstance(item, (T.FloatType, T.DoubleType)) else 'double'}>"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_points(batch, size, scale)[0]))

    kept = vectors.select("vec_id", embedding.alias("embedding")).mapInArrow(keep, held)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "embedding").limit(clusters).collect()
    now = [[int(v) for v in whole(np.array(r.embedding, float), scale)] for r in first]
    fixed = list(dict.fromkeys(map(tuple, now)))[:pivots]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, _, x = _points(batch, size, scale)
            far = np.array([[root(int(v)) for v in squared(x, p)] for p in fixed]).reshape(len(fixed), len(x)).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fixed)), pa.array(far.ravel()))
            own = batch.filter(pa.array(right))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], ["vec_id", "embedding", "to_pivots"])

    points = materialise(vectors.select("vec_id", embedding.alias("embedding")).mapInArrow(measure, held + ", to_pivots array<double>"), "cluster-points")

    def assigned(batch: pa.RecordBatch, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, _, x = _points(batch, size, scale)
        far = batch.column(2).flatten().to_numpy().reshape(len(x), len(fixed))
        return x, *nearest(x, far, centroids, fixed)[:2]

    def sums(centroids: list[list[int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [[0] * (size + 1) for _ in centroids]
            for batch in (b for b in batches if b.num_rows):
                x, number, _ = assigned(batch, centroids)
                for c in np.unique(number).tolist():
                    own = x[number == c]
                    total[c] = [a + int(b) for a, b in zip(total[c], [*own.sum(0), len(own)], strict=True)]
            rows = [(c, j, place, digit) for c, row in enumerate(total) if row[-1] for j, v in enumerate(row) for place, digit in limbs(v)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], ["c", "j", "place", "digit"])

        parts = points.mapInArrow(run, "c long, j long, place long, digit long")
        return parts.groupBy("c", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("total"))

    for _ in range(rounds if now else 0):
        found: dict[tuple[int, int], int] = {}
        for r in sums(now).collect():  # a number for each component and limb of each centroid
            found[r.c, r.j] = found.get((r.c, r.j), 0) + int(r.total) * 10 ** (LIMB * r.place)
        now = [[found[c, j] // found[c, size] for j in range(size)] if (c, size) in found else old for c, old in enumerate(now)]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            _, number, distance = assigned(batch, now)
            fits = [int(d) if d <= LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    out = materialise(points.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "cluster-assigned")
    discard(points)
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = out.groupBy("cluster").agg(whole_sum.alias("s")).collect()  # a row for each centroid
    inertia = None if any(r.s is None for r in each) else sum(int(r.s) for r in each)
    named = [(r.cluster, *(None if v is None or v > LONG else int(v) for v in (r.s, inertia)), hashlib.sha256(",".join(map(str, now[r.cluster])).encode()).hexdigest()) for r in each]
    sides = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(sides), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for the rows of cluster() over the table embeddings, a group of expressions for each round."""
    steps = f"""
        with v as materialized (
            select row_number() over () i, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) e from embeddings
            where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as materialized (
            select row_number() over (order by sha256('{seed}:' || vec_id), e) - 1 c, e from v order by sha256('{seed}:' || vec_id), e limit {clusters})"""
    for r in range(rounds + 1):
        steps += f""",
        a{r} as materialized (
            select v.i, min({{'d': list_sum(list_transform(range(1, {size + 1}), lambda j: (v.e[j] - k.e[j]) * (v.e[j] - k.e[j])))::bigint, 'c': k.c}}) b
            from v, c{r} k group by v.i)"""
        if r < rounds:
            steps += f""",
        m{r} as (
            select b.c c, j, sum(v.e[j])::bigint s, count(*) n from v join a{r} using (i), unnest(range(1, {size + 1})) t(j) group by b.c, j),
        c{r + 1} as materialized (
            select k.c, coalesce(x.e, k.e) e from c{r} k
            left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) e from m{r} group by c) x on x.c = k.c)"""
    return (
        steps
        + f"""
        select v.vec_id, b.c::int "cluster", b.d distance, (sum(b.d) over (partition by b.c))::bigint cluster_inertia, (sum(b.d) over ())::bigint inertia,
            sha256(array_to_string(k.e, ',')) centroid_sha256
        from v join a{rounds} using (i) join c{rounds} k on k.c = b.c"""
    )
