"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different things: one the words and the make-up of the whole text, one the page's metadata
(source, language, length). Both start from the labelled rows; in each round each labels all the unlabelled documents
of which its calibrated probability is beyond CONFIDENT and hands them to the other, which is fitted again. The handed
documents stay where they are: what the fit needs of them, the gradient and the curvature of their loss at the round's
model, is summed up on the executors. Each view is calibrated on one held-out fold, and a third logistic model combines
the calibrated views on another. This is done for two targets, low quality and toxicity, and a document is kept if
neither is more likely than not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, partitions, tidy

#: Labelled rows that are fitted at most (those with the smallest hash of their id); a parameter of train().
LABELLED_ROWS = 10_000
#: Rounds of exchange, and the calibrated probability from which on a document is handed over. The documents handed over
#: for a class count together as much as its labelled rows.
ROUNDS, CONFIDENT = 3, 0.97
#: Buckets that a model of a view is fitted over at most, and the least chi-squared that they have (99.8 %).
SELECTED, LEAST_CHI = 250, 10.0
#: Lengths of the word beginnings that are features beside whole words (inflected words share them).
PREFIXES = (4, 5)
#: Buckets of words, and of metadata values; one in FOLDS labelled rows calibrates, and another one combines.
WORD_BUCKETS, META_BUCKETS, FOLDS = 1 << 18, 1 << 12, 6
#: Tasks that add up what the executors send to the driver.
ADDERS = 4
_BINS, _STYLES = 16, 12
_UPPER, _LETTERS, _DIGITS, _BLANK = (bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), bytes(range(48, 58)), b" \t\n\r\x0b\x0c")
_EDGE = ".,!?;:*#$%&|\"'()[]{}<>-_=+/\\`~^@"


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_BUCKETS


def _bin(x: float) -> int:
    return min(_BINS - 1, max(0, int(x)))


def text_features(text: str | None) -> np.ndarray:
    """Sorted bucket numbers of the whole text: which words and word beginnings it holds, and bins of its make-up."""
    text = text or ""
    raw, words = text.encode(), text.lower().split()
    bare = {w.strip(_EDGE) for w in set(words)}
    found = {_bucket(w) for w in bare}
    found |= {_bucket(b) for b in {"^" + w[:n] for w in bare for n in PREFIXES if len(w) > n}}
    n, w = max(1, len(raw)), max(1, len(words))
    letters = n - len(raw.translate(None, _LETTERS))
    upper = n - len(raw.translate(None, _UPPER))
    blank = n - len(raw.translate(None, _BLANK))
    digits = n - len(raw.translate(None, _DIGITS))
    symbols = max(0, len(raw) - letters - blank - digits)
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:]))
    style = [
        16 * symbols / n, 64 * symbols / n, 16 * upper / max(1, letters), 32 * digits / n, letters / w, 16 * len(set(words)) / w,
        16 * repeats / w, 2 * np.log2(w), np.log2(len(lines)) * 2, 2 * np.log2(1 + n / len(lines)), 16 * text.count(" | ") / w * 2, 16 * (len(lines) - len(set(lines))) / len(lines),
    ]
    found |= {WORD_BUCKETS + k * _BINS + _bin(x) for k, x in enumerate(style)}
    return np.array(sorted(found), np.int32)


def meta_features(source: object, lang: object, n_chars: object) -> np.ndarray:
    """Bucket numbers of the metadata: source, language, both, and the length's order of magnitude."""
    size = "none" if n_chars is None else str(_bin(np.log2(1 + max(0, float(n_chars)))))
    values = [f"s{source}", f"l{lang}", f"sl{source}/{lang}", f"n{size}", f"ln{lang}/{size}"]
    return np.array(sorted({zlib.crc32(v.encode()) % META_BUCKETS for v in values}), np.int32)


@dataclass
class Rows:
    """Sparse binary rows."""

    index: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*rows, np.zeros(0, np.int32)]), np.cumsum([0] + [len(r) for r in rows]))

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([self.index[self.start[i] : self.start[i + 1]] for i in which])

    def __len__(self) -> int:
        return len(self.start) - 1

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.index], dtype=np.float64)])
        return total[self.start[1:]] - total[self.start[:-1]]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    chosen: np.ndarray | None = None

    def logit(self, rows: Rows) -> np.ndarray:
        """Calibrated log-odds."""
        return self.scale * (rows.sums(self.weights) + self.bias) + self.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def counts(rows: Rows, y: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows have each bucket, and how many of those with y = 1."""
    owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
    return np.bincount(rows.index, minlength=buckets).astype(float), np.bincount(rows.index, weights=y[owner], minlength=buckets)


def telling(has: np.ndarray, with_y: np.ndarray, n: int, p: float, most: int = SELECTED) -> np.ndarray:
    """The buckets that depend most on y, by chi-squared, of counts() over n rows of which p have y = 1; buckets of fewer than
    three rows do not count."""
    gap = with_y * n - has * p
    chi = np.where(has >= 3, n * gap**2 / np.maximum(has * (n - has) * p * (n - p), 1e-9), 0)
    order = np.argsort(-chi, kind="stable")[:most]
    return np.sort(order[chi[order] >= LEAST_CHI])


@dataclass
class Handed:
    """Of the documents handed to a view for a class: how many, and the gradient and curvature of their loss at the model at."""

    n: float
    gradient: np.ndarray
    curvature: np.ndarray
    at: np.ndarray


def dense(rows: Rows, chosen: np.ndarray, buckets: int) -> np.ndarray:
    """0/1 columns of the chosen buckets."""
    column = np.full(buckets, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
    own = column[rows.index]
    x = np.zeros((len(rows), len(chosen)), np.float32)
    x[owner[own >= 0], own[own >= 0]] = 1
    return x


def fit_linear(rows: Rows, y: np.ndarray, buckets: int, chosen: np.ndarray, handed: list[Handed]) -> Linear:
    """Ridge logistic regression over the chosen buckets, of labelled rows and what was handed over."""
    w = fit_dense(dense(rows, chosen, buckets), y, steps=10, penalty=1.0, handed=[(min(1.0, (y == c).sum() / h.n), h) for c, h in enumerate(handed) if h.n])
    weights = np.zeros(buckets, np.float32)
    weights[chosen] = w[:-1]
    return Linear(weights, float(w[-1]), chosen=chosen)


def fit_dense(x: np.ndarray, y: np.ndarray, steps: int = 30, penalty: float = 1e-2, handed: list[tuple[float, Handed]] = ()) -> np.ndarray:
    """Newton steps of a logistic regression; the last weight is the bias. A step is halved while it makes the loss
    larger. What was handed over counts by its weight, as a quadratic loss around the model that it was taken at."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        own = float(np.logaddexp(0, z).sum() - z @ y + 0.5 * (ridge * w * w).sum())
        return own + sum(a * float(h.gradient @ (w - h.at) + 0.5 * (w - h.at) @ h.curvature @ (w - h.at)) for a, h in handed)

    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        curve = ((x * (p * (1 - p))[:, None].astype(x.dtype)).T @ x + np.diag(ridge + 1e-9)).astype(float)
        slope = x.T @ (p - y) + ridge * w
        for a, h in handed:
            curve += a * h.curvature
            slope = slope + a * (h.gradient + h.curvature @ (w - h.at))
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-3:
            size /= 2
        if then > now - 1e-7 * abs(now):
            break
        w, now = w - size * step, then
    return w


def calibrated(view: Linear, rows: Rows, y: np.ndarray) -> Linear:
    """The view with its log-odds scaled to fit held-out labels."""
    a, b = fit_dense(np.clip(rows.sums(view.weights) + view.bias, -30, 30)[:, None], y)
    return Linear(view.weights, view.bias, max(float(a), 0.0), float(b), view.chosen)


@dataclass
class Head:
    text: Linear
    meta: Linear
    combine: np.ndarray

    def probability(self, text: Rows, meta: Rows) -> np.ndarray:
        a, b = (np.clip(x, -30, 30) for x in (self.text.logit(text), self.meta.logit(meta)))
        return _sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


_SIZES = {"text": WORD_BUCKETS + _STYLES * _BINS, "meta": META_BUCKETS}


def folds(y: np.ndarray) -> list[np.ndarray]:
    """Which rows are fitted, calibrate and combine. Where a part lacks a class, as with very few labels, all rows serve for all
    three."""
    part = np.arange(len(y)) % FOLDS
    parts = [np.nonzero(w)[0] for w in (part > 1, part == 0, part == 1)]
    return [np.arange(len(y))] * 3 if any(len(np.unique(y[f])) < 2 for f in parts) else parts


class CoTraining:
    """One target: labelled rows in three parts (fit, calibrate, combine), and the models of both views. The rows need no
    other buckets than the chosen ones, where these are given."""

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray, chosen: dict[str, np.ndarray] | None = None):
        self.rows, self.y = {"text": text, "meta": meta}, y
        self.base, self.calibrate, self.combine = folds(y)
        own = y[self.base]
        self.chosen = chosen or {v: telling(*counts(rows.take(self.base), own, _SIZES[v]), len(own), own.sum()) for v, rows in self.rows.items()}
        self.models: dict[str, Linear] = {}
        self.fit({})

    def fit(self, handed: dict[str, list[Handed]]) -> None:
        for v, rows in self.rows.items():
            fitted = fit_linear(rows.take(self.base), self.y[self.base], _SIZES[v], self.chosen[v], handed.get(v, []))
            self.models[v] = calibrated(fitted, rows.take(self.calibrate), self.y[self.calibrate])

    def head(self) -> Head:
        x = np.column_stack([np.clip(self.models[v].logit(rows.take(self.combine)), -30, 30) for v, rows in self.rows.items()])
        return Head(self.models["text"], self.models["meta"], fit_dense(x, self.y[self.combine], penalty=1.0))


def handed_over(features: DataFrame, models: list[dict[str, Linear]]) -> list[dict[str, list[Handed]]]:
    """For each of the models (a target's two views): what each view is handed by the other of all unlabelled documents,
    class 0 and class 1. Every task adds up its documents, and a few more add up the tasks."""
    sent = features.sparkSession.sparkContext.broadcast(models)

    def empty(models: list[dict[str, Linear]]) -> dict[int, np.ndarray]:
        widths = [len(m[v].chosen) + 1 for m in models for v in ("text", "meta")]
        return {2 * k + c: np.zeros(1 + w + w * w) for k, w in enumerate(widths) for c in (0, 1)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        total = empty(models)
        for batch in batches:
            for part in (batch.slice(s, 1000) for s in range(0, len(batch), 1000)):
                rows = {"text": _rows(part.column(0)), "meta": _rows(part.column(1))}
                for k, m in enumerate(models):
                    chance = {v: _sigmoid(m[v].logit(rows[v])) for v in rows}
                    for i, (v, other) in enumerate((("text", "meta"), ("meta", "text"))):
                        x = None
                        for c in (0, 1):
                            sure = chance[other] >= CONFIDENT if c else chance[other] <= 1 - CONFIDENT
                            if not sure.any():
                                continue
                            if x is None:
                                x = np.column_stack([dense(rows[v], m[v].chosen, _SIZES[v]), np.ones(len(part), np.float32)])
                            own, w = x[sure], np.append(m[v].weights[m[v].chosen], m[v].bias).astype(np.float32)
                            p = _sigmoid(own @ w)
                            t = total[4 * k + 2 * i + c]
                            t[0] += len(own)
                            t[1 : 1 + len(w)] += own.T @ (p - c)
                            t[1 + len(w) :] += ((own * (p * (1 - p))[:, None]).T @ own).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["slot", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty(sent.value)
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[slot] += np.frombuffer(sums.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["slot", "sums"])

    pool = features.where("quality is null and toxic is null").select("text", "meta").coalesce(partitions(features.sparkSession))
    added = pool.mapInArrow(tidy(add), "slot int, sums binary").repartition(ADDERS).mapInArrow(tidy(merge), "slot int, sums binary")
    total = empty(models)
    for r in added.toLocalIterator():
        total[r.slot] += np.frombuffer(r.sums)
    out = []
    for k, m in enumerate(models):
        views = {}
        for i, v in enumerate(("text", "meta")):
            w = np.append(m[v].weights[m[v].chosen], m[v].bias).astype(float)
            sums = [total[4 * k + 2 * i + c] for c in (0, 1)]
            views[v] = [Handed(t[0], t[1 : 1 + len(w)], t[1 + len(w) :].reshape(len(w), len(w)), w) for t in sums]
        out.append(views)
    return out


def _rows(column: pa.Array) -> Rows:
    """Bucket lists of a batch."""
    ends = column.offsets.to_numpy()
    return Rows(column.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64))


def _slices(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, as views of its numbers."""
    out = []
    for chunk in column.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _lists(batch: pa.RecordBatch, first: int) -> list[pa.Array]:
    """Bucket lists of both views, from the columns text, source, lang, n_chars."""
    text = [text_features(t.as_py()) for t in batch.column(first)]
    meta = [meta_features(*m) for m in zip(*(batch.column(first + i).to_pylist() for i in (1, 2, 3)), strict=True)]
    return [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([*x, np.zeros(0, np.int32)])) for x in (text, meta)]


def _features(rows: DataFrame) -> DataFrame:
    """(row, text, meta, quality, toxic) with text and meta as bucket numbers, of rows (row, text, source, lang, n_chars, quality,
    toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 500) for s in range(0, len(batch), 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), *_lists(part, 1), part.column(5), part.column(6)], ["row", "text", "meta", "quality", "toxic"])

    buckets = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["row"], T.StructField("text", buckets), T.StructField("meta", buckets), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    return rows.mapInArrow(tidy(run), schema)


def _inputs(docs: DataFrame) -> list[F.Column]:
    """The columns that the views look at; missing metadata are null, a missing length is counted."""
    names = {f.name for f in docs.schema.fields}
    metadata = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    size = F.col("n_chars").cast("double") if "n_chars" in names else F.length("text").cast("double")
    return [F.col("text"), *metadata, size.alias("n_chars")]


def _prepared(docs: DataFrame, columns: list[str], labels: DataFrame | None = None, most: int = LABELLED_ROWS) -> DataFrame:
    """Features of every row of docs with the given columns in row, and the labels of at most `most` documents."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    nothing = F.lit(None).cast("int")
    if labels is None:
        return _features(docs.select(row, *_inputs(docs), nothing.alias("quality"), nothing.alias("toxic")))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = F.broadcast(picked.select(F.col("doc_id").alias("id"), "quality", "toxic"))
    inputs = docs.select(row, *_inputs(docs), F.col("doc_id").alias("id"))
    return _features(inputs.join(sample, "id", "left").select("row", "text", "source", "lang", "n_chars", "quality", "toxic"))


def _chosen(held: DataFrame, used: dict[str, dict[int, int]], y: dict[str, float]) -> dict[str, dict[str, np.ndarray]]:
    """Of each target the telling() buckets of both views: the rows of held (number, text, meta) that it fits count, of which
    used has the labels by number, and y how many are 1. Counts are made where the rows are."""
    numbers = sorted(set().union(*used.values()))
    marks = pa.table({"number": pa.array(numbers, pa.int64())} | {t: pa.array([own.get(i) for i in numbers], pa.int32()) for t, own in used.items()})
    rows = held.select("number", "text", "meta").join(F.broadcast(held.sparkSession.createDataFrame(marks)), "number")
    buckets = F.concat("text", F.transform("meta", lambda b: b + _SIZES["text"]))
    found = rows.select(F.explode(buckets).alias("bucket"), *used).groupBy("bucket").agg(*[f(t).alias(f"{t}_{n}") for t in used for n, f in (("n", F.count), ("y", F.sum))])
    table = found.where(" or ".join(f"{t}_n >= 3" for t in used)).toArrow()
    at, out = table["bucket"].to_numpy(), {}
    for t, own in used.items():
        has, with_y = np.zeros(sum(_SIZES.values())), np.zeros(sum(_SIZES.values()))
        has[at], with_y[at] = table[f"{t}_n"].to_numpy(), table[f"{t}_y"].fill_null(0).to_numpy()
        cut = {"text": slice(0, _SIZES["text"]), "meta": slice(_SIZES["text"], None)}
        out[t] = {v: telling(has[c], with_y[c], len(own), y[t]) for v, c in cut.items()}
    return out


def _only(held: DataFrame, buckets: dict[str, np.ndarray]) -> DataFrame:
    """(number, text, meta) of held with the given buckets of each view alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in ((1, "text"), (2, "meta")):
                rows = _rows(batch.column(i))
                stays = np.isin(rows.index, buckets[v])
                out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(stays)])[rows.start].astype(np.int32), rows.index[stays]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["number", "text", "meta"])

    return held.select("number", "text", "meta").mapInArrow(tidy(run), "number long, text array<int>, meta array<int>")


def _fit(features: DataFrame) -> dict[str, Head | None]:
    """Labelled rows stay on the executors: which buckets are telling is counted there, and the driver gets the rows' ids, labels
    and telling buckets, of which there are a few hundred whatever the texts' length."""
    labelled = features.where("quality is not null or toxic is not null")
    held = materialise(labelled.select(F.monotonically_increasing_id().alias("number"), F.col("row.doc_id").alias("doc_id"), "text", "meta", "quality", "toxic"), "quality-labelled")
    table = held.select("number", "doc_id", F.xxhash64("text", "meta").alias("mark"), "quality", "toxic").toArrow()
    # rows that share an id come by their features; those that share these too are alike
    sample = sorted(table.to_pylist(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["mark"]))
    heads: dict[str, Head | None] = {"low": None, "toxic": None}
    own, labels = {}, {}
    for name, column, target in (("low", "quality", 0), ("toxic", "toxic", 1)):
        rows = [r for r in sample if r[column] is not None]
        y = np.array([float(r[column] == target) for r in rows])
        if len(np.unique(y)) == 2:
            own[name], labels[name] = [r["number"] for r in rows], y
    if own:
        fitted = {name: folds(y)[0] for name, y in labels.items()}
        used = {name: {own[name][i]: int(labels[name][i]) for i in f.tolist()} for name, f in fitted.items()}
        chosen = _chosen(held, used, {name: labels[name][f].sum() for name, f in fitted.items()})
        few = _only(held, {v: np.unique(np.concatenate([c[v] for c in chosen.values()])) for v in ("text", "meta")}).toArrow()
        lists = dict(zip(few["number"].to_pylist(), zip(_slices(few["text"]), _slices(few["meta"]), strict=True), strict=True))
        targets = {name: CoTraining(*[Rows.of([lists[i][k] for i in rows]) for k in (0, 1)], labels[name], chosen[name]) for name, rows in own.items()}
        for _ in range(ROUNDS):
            for t, handed in zip(targets.values(), handed_over(features, [t.models for t in targets.values()]), strict=True):
                t.fit(handed)
        heads |= {name: t.head() for name, t in targets.items()}
    discard(held)
    return heads


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> dict[str, Head | None]:
    """Heads `low` (quality 0) and `toxic` from docs (doc_id, text, and where there are any source, lang, n_chars) and labels
    (doc_id, quality 0/1, toxic 0/1).

    At most `most` labelled documents are fitted, picked by hash of the id; their telling buckets and sums over all others are
    what reaches the driver. All other documents are the unlabelled ones that the views exchange. Labels that are null count
    for nothing, and of several labels for a document the larger ones do; rows that share an id share its labels. A head is
    None where its labels hold fewer than two classes, so with empty tables. Ids are of any type, null ids have no label.
    """
    return _fit(materialise(_prepared(docs, ["doc_id"], labels, most), "quality-features"))


def _chances(text: Rows, meta: Rows, heads: dict[str, Head | None]) -> tuple[np.ndarray, np.ndarray]:
    low, toxic = (heads[n].probability(text, meta) if heads[n] else np.zeros(len(text)) for n in ("low", "toxic"))
    return low, toxic


def _score(features: DataFrame, heads: dict[str, Head | None]) -> DataFrame:
    sent = features.sparkSession.sparkContext.broadcast(heads)
    kind = features.schema["row"].dataType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, toxic = _chances(_rows(batch.column(1)), _rows(batch.column(2)), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).field(0), pa.array(1 - low), pa.array(toxic), pa.array((low <= 0.5) & (toxic < 0.5))], ["doc_id", "quality_score", "toxic_score", "kept"])

    return features.select("row", "text", "meta").mapInArrow(tidy(run), f"doc_id {kind}, quality_score double, toxic_score double, kept boolean")


def score(docs: DataFrame, heads: dict[str, Head | None]) -> DataFrame:
    """doc_id, quality_score and toxic_score (probabilities), kept for every row of docs (doc_id, text, and where
    there are any source, lang, n_chars); kept is quality_score >= 0.5 and toxic_score < 0.5.

    Whole texts are looked at, however long. A null text counts as empty; null metadata are a value of their own; a head
    that could not be fitted gives quality 1 and toxicity 0. Repeated rows score alike. Other columns are ignored,
    whatever their names; an empty table gives an empty result. No shuffle.
    """
    return _score(_prepared(docs, ["doc_id"]), heads)


def classify(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """score() of docs by heads that train() fits on them; the features of each document are made once, and stored."""
    features = materialise(_prepared(docs, ["doc_id"], labels, most), "quality-features")
    return _score(features, _fit(features))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """The rows of docs that score() keeps with heads that train() fits on them; same columns, whatever their names. Odd rows
    fare as in score(). Features are made again for the rows that pass by, so that texts are not stored with them."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    rest = _inputs(docs)[1:]
    inputs = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), *rest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 500) for s in range(0, len(batch), 500)):
                row = part.column(0)
                text, meta = _lists(pa.RecordBatch.from_arrays([row.flatten()[at], *part.columns[1:]], ["text", "source", "lang", "n_chars"]), 0)
                low, toxic = _chances(_rows(text), _rows(meta), sent.value)
                yield pa.RecordBatch.from_struct_array(row.filter(pa.array((low <= 0.5) & (toxic < 0.5))))

    return inputs.mapInArrow(tidy(run), docs.schema)
