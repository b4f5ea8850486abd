"""Language identification by prediction by partial matching.

Every language has a byte context tree of variable order: the contexts of up to ORDER bytes that the texts it is learned from have
at least MIN_COUNT times. Those texts are all of the language, or a random share of them with about LEARNED bytes, so that trees
have a bounded size however large the corpus is. A byte's probability in a context follows escape method C: c / (n + d) if it was
seen there, else the escape d / (n + d) times its share of what the next shorter context gives to the bytes not seen
here, down to a uniform distribution. The statistics are frozen after training, so a text's code length under a
language is an exact sum over its bytes, and the shortest code names the language.

A byte that was seen in a context was seen in the shorter ones too, so what a context leaves to unseen bytes is a sum
over its own bytes: trees are made by joins of counts, and an escape is one number a context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, utf8_slices

#: Longest context in bytes; the least count of a context that is kept, and the bytes of text that a language is learned from at
#: most, on average (parameters of train()); seed of the share that is taken.
ORDER, MIN_COUNT, LEARNED, SEED = 4, 1, 64_000_000, 42
#: Bytes worked on at once, and entries of languages' trees that are sent together (about 50 bytes each); more languages are
#: scored in several passes. Both change the cost and no result.
PIECE, ENTRIES = 1 << 20, 4_000_000


class Index:
    """Positions of distinct non-negative keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            self.keys[s[free]] = keys[todo[free]]
            placed = self.keys[s] == keys[todo]
            self.at[s[placed]] = todo[placed]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for those that are not there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        todo = np.nonzero((held != keys) & (held >= 0))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


def _key(k: int | np.ndarray, gram: np.ndarray) -> np.ndarray:
    return gram | np.int64(k) << 41


@dataclass
class Tree:
    """The context trees of a few languages: code lengths of the bytes that any of them has seen in a context, and what each
    context adds for the others."""

    languages: list[str]
    grams: Index
    bits: np.ndarray  # gram, language -> code length of its last byte
    contexts: Index
    escapes: np.ndarray  # context, language -> what an unseen byte's code is longer than in the shorter context


def _pieces(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs of (rows, bytes, ends): each row's bytes after ORDER bytes of context (NUL before a text), at most about
    PIECE bytes together; a longer text comes in several runs."""
    data, ends = utf8_slices(column)
    rows, parts, size = [], [], 0
    pad = np.zeros(ORDER, np.uint8)
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for s in range(a, b, PIECE):
            e = min(b, s + PIECE)
            before = pad if s == a else data[s - ORDER : s]
            rows.append(row)
            parts += [before, data[s:e]]
            size += e - s + ORDER
            if size >= PIECE:
                yield rows, np.concatenate(parts), np.cumsum([len(x) + ORDER for x in parts[1::2]])
                rows, parts, size = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([len(x) + ORDER for x in parts[1::2]])


def _predicted(n: int, ends: np.ndarray) -> np.ndarray:
    """Positions that are text and not context."""
    own = np.ones(n, bool)
    starts = np.concatenate([[0], ends[:-1]])
    own[(starts[:, None] + np.arange(ORDER)[None, :]).ravel()] = False
    return np.nonzero(own)[0]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each byte follows each ORDER bytes, over all rows of docs (text, lang), lower-cased.
    Each task sends every distinct gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang: str) -> None:
            grams, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order]
            first = np.nonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))[0]
            held[lang] = [(grams[first], np.add.reduceat(counts, first))]

        for batch in batches:
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                for _, data, ends in _pieces(pc.utf8_lower(batch.column(0).filter(pc.equal(langs, lang)))):
                    at, grams = _predicted(len(data), ends), 0
                    for k in range(ORDER, -1, -1):
                        grams = grams << 8 | data[at - k].astype(np.int64)
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    if len(held[lang]) >= 16:
                        fold(lang)
        for lang in held:
            fold(lang)
            grams, counts = held[lang][0]
            for s in range(0, len(grams), 100_000):
                part = grams[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[s : s + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def share_of(docs: DataFrame, most: int) -> DataFrame:
    """docs (text, lang) that have both; of a language with more than `most` bytes of text a random share of its rows, with that
    many bytes on average. The draw depends on the seed and the place of a row, so a task that is run again draws the same."""
    own = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    sizes = own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes_")).select(F.col("lang").alias("lang_"), (F.lit(float(most)) / F.greatest("bytes_", F.lit(1))).alias("share_"))
    drawn = own.withColumn("draw_", F.rand(SEED))
    # a row for each language, as the trees have: texts stay where they are
    return drawn.join(F.broadcast(sizes), F.col("lang") == F.col("lang_")).where("draw_ < share_").select("text", "lang")


def tree_parts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts) of all languages of docs (text, lang): (lang, k, gram, bits) for every byte after a context of k bytes
    that occurs `least` times or more, and (lang, k, context, escape)."""
    orders = F.explode(F.array(*[F.lit(k) for k in range(ORDER + 1)]))
    counted = gram_counts(docs).withColumn("k", orders).select("lang", "k", F.expr("gram & (shiftleft(1L, 8 * (k + 1)) - 1)").alias("gram"), "n")
    counted = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).withColumn("context", F.expr("shiftright(gram, 8)"))
    counted = materialise(counted, "language-grams")
    kept = counted.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("d")).where(F.col("total") >= least)
    seen = materialise(counted.join(kept.hint("merge"), ["lang", "k", "context"]).withColumn("p", F.col("n") / (F.col("total") + F.col("d"))), "language-seen")
    discard(counted)
    shorter = seen.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("tail"), F.col("p").alias("short_p"))
    with_tail = seen.withColumn("tail", F.expr("gram & (shiftleft(1L, 8 * k) - 1)"))
    joined = with_tail.join(shorter.hint("merge"), ["lang", "k", "tail"], "left")
    used = joined.groupBy("lang", "k", "context", "total", "d").agg(F.sum(F.coalesce("short_p", F.lit(1 / 256))).alias("used"))
    rest = F.greatest(1 - F.col("used"), F.lit(1e-12))
    contexts = used.select("lang", "k", "context", F.log2((F.col("total") + F.col("d")) * rest / F.col("d")).alias("escape"))
    return seen.select("lang", "k", "gram", (-F.log2("p")).alias("bits")), contexts


def train(docs: DataFrame, most: int = LEARNED, least: int | None = None) -> list[Tree]:
    """Trees from docs (text, lang), a few languages in each so that a tree has about ENTRIES grams. Rows without a text or a
    language teach nothing; without any there are no trees. A language is learned from about `most` bytes of its texts at most,
    and contexts that occur less than `least` times (MIN_COUNT) are left out; so what the driver gets and sends out is bounded
    by the number of languages."""
    grams, contexts = (materialise(df, "language-tree") for df in tree_parts(share_of(docs, most), MIN_COUNT if least is None else least))
    blocks: list[list[str]] = []
    size = 0
    for r in sorted(grams.groupBy("lang").count().toLocalIterator(), key=lambda r: r.lang):
        if not blocks or size + r["count"] > ENTRIES:
            blocks.append([])
            size = 0
        blocks[-1].append(r.lang)
        size += r["count"]
    trees = [_tree(b, *(df.where(F.col("lang").isin(b)).toArrow() for df in (grams, contexts))) for b in blocks]
    discard(grams, contexts)
    return trees


def _tree(langs: list[str], grams: pa.Table, contexts: pa.Table) -> Tree:
    number = {lang: i for i, lang in enumerate(langs)}

    def spread(table: pa.Table, name: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        own = _key(table["k"].to_numpy().astype(np.int64), table[name].to_numpy())
        keys, row = np.unique(own, return_inverse=True)
        names = table["lang"].combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        column = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(table) else np.zeros(0, np.int64)
        out = np.full((len(keys), len(langs)), np.nan)
        out[row, column] = table[value].to_numpy()
        return keys, out

    keys, bits = spread(grams, "gram", "bits")
    nodes, escapes = spread(contexts, "context", "escape")
    escapes = np.nan_to_num(escapes)  # a language that lacks a context goes on with the shorter one
    index, inner = Index(keys), Index(nodes)
    order, gram = keys >> 41, keys & ((np.int64(1) << 41) - 1)
    for k in range(ORDER + 1):
        own = np.nonzero(order == k)[0]
        if k:
            short = bits[index.find(_key(k - 1, gram[own] & ((np.int64(1) << 8 * k) - 1)))]
        else:
            short = np.full((len(own), len(langs)), 8.0)
        more = escapes[inner.find(_key(k, gram[own] >> 8))]
        bits[own] = np.where(np.isnan(bits[own]), short + more, bits[own])
    return Tree(langs, index, bits, inner, escapes)


def code_lengths(tree: Tree, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each run's own bytes under each language."""
    at = _predicted(len(data), ends)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << 8 | data[at - k].astype(np.int64)
    found = tree.grams.find(_key(ORDER, gram))
    cost = tree.bits[found]
    todo = np.nonzero(found < 0)[0]
    if len(todo):
        cost[todo] = 0
    for k in range(ORDER, -1, -1):
        if not len(todo):
            break
        own = gram[todo] & ((np.int64(1) << 8 * (k + 1)) - 1)
        node = tree.contexts.find(_key(k, own >> 8))
        cost[todo[node >= 0]] += tree.escapes[node[node >= 0]]
        if not k:
            cost[todo] += 8.0
            break
        found = tree.grams.find(_key(k - 1, own & ((np.int64(1) << 8 * k) - 1)))
        cost[todo[found >= 0]] += tree.bits[found[found >= 0]]
        todo = todo[found < 0]
    firsts = np.concatenate([[0], ends[:-1]]) - ORDER * np.arange(len(ends))
    return np.add.reduceat(cost, firsts, axis=0)


def predict(docs: DataFrame, trees: list[Tree]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id of any type, text); only the text is looked at.

    lang_pred is the language whose code for the whole lower-cased text is shortest (ties: the first by name), score
    the share of its probability among all languages. A text that is null or holds no letter, or a model without
    languages, gives `und` and score 0. Repeated rows give repeated results; texts may be of any length; other columns are
    ignored, whatever their names; an empty table gives an empty result. Each tree is a pass over the texts, and nothing is
    shuffled.
    """
    langs = [x for t in trees for x in t.languages]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.array().cast("array<double>").alias("bits"))
    for tree in trees:
        sent = docs.sparkSession.sparkContext.broadcast(tree)

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for batch in batches:
                total = np.zeros((len(batch), len(tree.languages)))
                for at, data, ends in _pieces(pc.utf8_lower(batch.column(1))):
                    np.add.at(total, at, code_lengths(tree, data, ends))
                before = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 0))
                both = np.concatenate([before, total], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * both.shape[1], both.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["doc_id", "text", "letter", "bits"])

        rows = rows.mapInArrow(add, f"doc_id {kind}, text string, letter boolean, bits array<double>")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = np.array(batch.column(1).to_pylist(), bool)
            if langs and len(batch):
                total = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                best = total.argmin(1)
                share = 1 / np.exp2(np.maximum(total.min(1, keepdims=True) - total, -1000)).sum(1)
                names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            else:
                names, share = ["und"] * len(batch), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letter, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "letter", "bits").mapInArrow(name, f"doc_id {kind}, lang_pred string, score double")
