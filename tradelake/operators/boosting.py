"""Boosted regression trees of many targets at once, grown level by level from histograms of gradients.

Features are cut into bins once. A pass over the rows adds up, for every target, open node, feature and bin, the gradients and the
rows; partial sums of the tasks are merged, and the splits that they give are few enough to go out again with the next pass. So
the passes are as many as trees times levels, however many targets there are, and rows stay in the tasks that hold them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_folder

#: Rows of a block, numbers of targets times rows that a task takes at least, and the trees after which the state of the rows is
#: written to the shared folder, so that a lost executor costs no more than these. They change the cost and no result.
BLOCK_ROWS, TASK_CELLS, CHECKPOINT_TREES = 20_000, 40_000, 25
#: A split must lower the squared error by more than this.
LEAST_GAIN = 1e-6


@dataclass
class Trees:
    """Trees of all targets: in each a node has two children below it, and rows whose bin is over the node's go right. A node
    that was not split has all rows go left. base (targets), feature and cut (targets, trees, nodes), value (targets, trees,
    leaves), edges of bins by feature."""

    edges: list[np.ndarray]
    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(targets, rows) for features (rows, features)."""
        bins = binned(x, self.edges)
        out = np.repeat(self.base[:, None], len(x), 1)
        for t in range(self.feature.shape[1]):
            leaf = descend(bins, self.feature[:, t], self.cut[:, t], self.depth)
            out += np.take_along_axis(self.value[:, t], leaf, 1)
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(features, rows) numbers of bins: how many edges of its feature are below a value."""
    return np.array([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], np.int64).reshape(len(edges), len(x))


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """(targets, rows) numbers of the nodes that rows reach after so many levels; nodes are numbered by level from 0 on, and a
    level's nodes lie in feature and cut (targets, nodes) behind those of the levels above."""
    rows = np.arange(bins.shape[1])
    node = np.zeros((len(feature), len(rows)), np.int64)
    for level in range(levels):
        at = node + (1 << level) - 1
        f, c = np.take_along_axis(feature, at, 1), np.take_along_axis(cut, at, 1)
        node = 2 * node + ((f >= 0) & (bins[np.maximum(f, 0), rows] > c))
    return node


def histogram(blocks: Iterator[dict], feature: np.ndarray, cut: np.ndarray, level: int, width: int) -> Iterator[np.ndarray]:
    """(2, targets, nodes, features, bins): residuals and rows of a task, in one array."""
    total = None
    for b in blocks:
        bins, (targets, _) = b["bins"], b["y"].shape
        nodes, features = 1 << level, len(bins)
        if total is None:
            total = np.zeros((2, features, targets * nodes * width))
        h, i = np.nonzero(b["train"])
        node = descend(bins, feature, cut, level)
        place, rest = (h * nodes + node[h, i]) * width, b["y"][h, i] - b["f"][h, i]
        for f in range(features):
            at = place + bins[f, i]
            total[0, f] += np.bincount(at, rest, total.shape[2])
            total[1, f] += np.bincount(at, minlength=total.shape[2])
    if total is not None:
        yield total.reshape(2, features, targets, nodes, width).transpose(0, 2, 3, 1, 4)


def best_splits(total: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, cut (targets, nodes; feature -1 without a split) and (2, targets, nodes, 2) sums and rows of both sides: the cut
    with the largest gain, ties to the first feature and bin."""
    left = np.cumsum(total, -1)
    whole = left[:, :, :, :1, -1:]
    right = whole - left
    score = lambda s: s[0] * s[0] / (s[1] + smooth)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[1] >= 1) & (right[1] >= 1), gain, -np.inf)
    targets, nodes, _, width = gain.shape
    flat = gain.reshape(targets, nodes, -1)
    at = flat.argmax(-1)
    split = np.take_along_axis(flat, at[..., None], -1)[..., 0] > LEAST_GAIN
    feature, cut = at // width, at % width
    i, j = np.ogrid[:targets, :nodes]
    sides = np.where(split[None, :, :, None], np.stack([left[:, i, j, feature, cut], right[:, i, j, feature, cut]], -1), np.stack([whole[..., 0, 0], 0 * whole[..., 0, 0]], -1))
    return np.where(split, feature, -1), np.where(split, cut, 0), sides


def _moved(block: dict, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> dict:
    return block | {"f": block["f"] + np.take_along_axis(value, descend(block["bins"], feature, cut, depth), 1)}


def _start(blocks: Iterator[dict]) -> Iterator[np.ndarray]:
    for b in blocks:
        yield np.array([np.where(b["train"], b["y"], 0).sum(1), b["train"].sum(1)])


def _errors(blocks: Iterator[dict]) -> Iterator[np.ndarray]:
    for b in blocks:
        test = b["test"]
        e = np.where(test, b["y"] - b["f"], 0)
        yield np.array([np.abs(e).sum(1), (e * e).sum(1), test.sum(1)])


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every feature: at most bins - 1 edges, so that a feature of few values has a bin for each."""
    share = [i / bins for i in range(1, bins)]
    few = rows.agg(*[F.percentile_approx(c, share, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q, float)) if q is not None else np.zeros(0) for q in few]


def as_blocks(rows: DataFrame, features: list[str], targets: list[str], train: list[str], edges: list[np.ndarray]) -> RDD:
    """Blocks of rows: bins, y, f, and which rows a target is fitted and tested on."""
    width, n = len(features), len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, BLOCK_ROWS) for s in range(0, batch.num_rows, BLOCK_ROWS)):
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                y = np.array(columns[width : width + n], float).reshape(n, part.num_rows)
                has = ~np.isnan(y)
                mark = np.array([[bool(v) for v in c] for c in columns[width + n :]], bool).reshape(n, part.num_rows)
                x = np.array(columns[:width], float).reshape(width, part.num_rows).T
                block = {"bins": binned(x, edges).astype(np.uint8 if max(map(len, edges), default=0) < 256 else np.int64), "y": y, "f": np.zeros_like(y), "train": has & mark, "test": has & ~mark}
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return rows.select(*features, *targets, *train).mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r.block))


def fit(rows: DataFrame, features: list[str], targets: list[str], train: list[str], trees: int = 200, depth: int = 4, rate: float = 0.1, bins: int = 32, smooth: float = 1.0) -> tuple[Trees, np.ndarray]:
    """Trees for every target column of rows, and (3, targets) sums of |error| and error², and rows, over the rows that are
    not trained on. train: for each target the column that says which rows are; a row without a target is in neither.

    Trees start from the mean of the trained rows, fit what is left of it (squared error) and add rate times the smoothed mean
    of a leaf: sum / (rows + smooth). A split must leave a row on both sides and gain in sum² / (rows + smooth). A feature's null
    is in the last bin. Targets without trained rows have no splits and predict zero. rows is read once."""
    spark = rows.sparkSession
    context = spark.sparkContext
    edges = bin_edges(rows, features, bins)
    width = max(map(len, edges), default=0) + 1
    tasks = max(1, -(-rows.count() * len(targets) // TASK_CELLS))
    placed = rows.coalesce(tasks) if tasks < context.defaultParallelism else rows.repartition(tasks)
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_folder(spark))
    state = as_blocks(placed, features, targets, train, edges).persist(StorageLevel.MEMORY_AND_DISK)
    nothing = np.zeros((2, len(targets)))
    sums, n = state.mapPartitions(_start).fold(nothing, np.add)
    base = np.where(n > 0, sums / np.maximum(n, 1), 0.0)
    state, last = state.map(lambda b, base=base: b | {"f": b["f"] + base[:, None]}).persist(StorageLevel.MEMORY_AND_DISK), state
    out = Trees(edges, base, np.full((len(targets), trees, (1 << depth) - 1), -1), np.zeros((len(targets), trees, (1 << depth) - 1), np.int64), np.zeros((len(targets), trees, 1 << depth)), depth)
    empty = not n.any()
    for t in range(0 if empty else trees):
        feature, cut, value = out.feature[:, t], out.cut[:, t], out.value[:, t]
        for level in range(depth):
            own = slice((1 << level) - 1, (2 << level) - 1)
            total = state.mapPartitions(partial(histogram, feature=feature, cut=cut, level=level, width=width)).treeReduce(np.add)
            feature[:, own], cut[:, own], sides = best_splits(total, smooth)
            if level == 0 and last is not None:
                last.unpersist()
        value[:] = (rate * sides[0] / (sides[1] + smooth)).reshape(len(targets), -1)
        state, last = state.map(partial(_moved, feature=feature, cut=cut, value=value, depth=depth)).persist(StorageLevel.MEMORY_AND_DISK), state
        if (t + 1) % CHECKPOINT_TREES == 0:
            state.checkpoint()
    errors = state.mapPartitions(_errors).fold(np.zeros((3, len(targets))), np.add)
    for held in (state, last):
        if held is not None:
            held.unpersist()
    return out, errors


def predict(rows: DataFrame, features: list[str], trees: Trees, targets: list[str]) -> DataFrame:
    """rows with a double column for each target. The trees grow with targets x trees x nodes, not with the data."""
    held = rows.sparkSession.sparkContext.broadcast(trees)
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in features], float).reshape(len(features), batch.num_rows).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p) for p in held.value.predict(x)]], [*names, *targets])

    return rows.mapInArrow(run, ", ".join([kinds, *[f"`{t}` double" for t in targets]]))
