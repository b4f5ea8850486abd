"""Packing along a space-filling curve: hashed document vectors, projected to few dimensions, range-sorted by Hilbert key."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, utf8_slices

#: Dimensions of the projection and bits of each: 60 bits of key. GRAM: bytes of a hashed feature, of which there are 2 ** 16.
DIMENSIONS, BITS, GRAM, SEED = 4, 15, 4, 42
#: Words whose ids a worker keeps, the bytes of the longest of them, and the ids that are kept at most.
CACHE_WORDS, CACHE_BYTES, CACHE_IDS = 600_000, 64, 8_000_000
#: Bytes of text that are tokenized at once (a longer document is taken alone).
STEP = 4 << 20


def signs() -> np.ndarray:
    """For each feature 0 or 1 in each dimension, as 16-bit fields of one number, so that one sum counts all dimensions."""
    bits = np.random.default_rng(SEED).integers(0, 2, (1 << 16, DIMENSIONS), np.uint64)
    return (bits << (16 * np.arange(DIMENSIONS, dtype=np.uint64))).sum(1, dtype=np.uint64)


def projected(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, dimensions), integers below 2 ** BITS: the share of a document's byte 4-grams, A-Z taken as a-z, whose sign is
    positive. That is the hashed vector of its grams, of length one in sum, projected by random signs."""
    n = len(ends) - 1
    counts = np.zeros((n, DIMENSIONS), np.int64)
    grams = np.maximum(np.diff(ends) - GRAM + 1, 0)
    if len(data) >= GRAM:
        low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint16)
        code = np.zeros(len(low) - GRAM + 1, np.uint16)
        for i in range(GRAM):
            code = (code ^ low[i : i + len(code)]) * np.uint16(0x9E37)
            code ^= code >> np.uint16(7)
        fields = signs()[code]
        own = np.nonzero(grams)[0]
        # 16 bits hold the sums of 2 ** 15 grams; what lies between a document's last gram and the next document is a piece too
        cuts = np.unique(np.concatenate([*(np.arange(ends[i], ends[i] + grams[i], 1 << 15) for i in own), ends[own] + grams[own], [0]]).astype(np.int64))
        cuts = cuts[cuts < len(fields)]
        total = np.add.reduceat(fields, cuts)
        doc = np.searchsorted(ends, cuts, "right") - 1
        inside = cuts < ends[doc] + grams[np.minimum(doc, n - 1)]
        for d in range(DIMENSIONS):
            np.add.at(counts[:, d], doc[inside], (total[inside] >> np.uint64(16 * d) & np.uint64(0xFFFF)).astype(np.int64))
    return counts * ((1 << BITS) - 1) // np.maximum(grams, 1)[:, None]


def hilbert(points: np.ndarray) -> np.ndarray:
    """The place of each point (rows of integers below 2 ** BITS) on the Hilbert curve, by the transposed form: from the highest
    bit on, quadrants are reflected and exchanged, and the Gray code of what is left is undone."""
    x = points.astype(np.int64).T.copy()
    bit = 1 << (BITS - 1)
    while bit > 1:
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] ^= np.where(on, bit - 1, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (BITS - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


class WordIds:
    """Token ids of texts. Words between ASCII blanks are tokenized by the library once and kept: the vocabulary's rule drops
    blanks, so no token reaches over one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        pre, steps = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        if spec.get("post_processor") or spec.get("truncation") or spec.get("padding") or "Removed" not in pre or "Lowercase" not in steps or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("not a lower-case word vocabulary that drops blanks")
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that reach over blanks are not supported")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.library = Tokenizer.from_file(path)
        names = self.library.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for s, i in names.items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, words: list[bytes]) -> None:
        """Tokenize words that have the next codes."""
        texts = [w.decode() for w in words]
        found: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if len(t) <= CACHE_BYTES and t.isalpha() and unicodedata.normalize("NFC", t).lower().isalpha()]
        for s in range(0, len(plain), 4096):  # words of letters are one word each to the library too, so many go in one text
            some = plain[s : s + 4096]
            ids = np.array(self.library.encode(" ".join(texts[i] for i in some), add_special_tokens=False).ids, np.uint32)
            cut = np.nonzero(self.closes[ids])[0] + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                for i, part in zip(some, np.split(ids, cut[:-1]), strict=True):
                    found[i] = part
        rest = [i for i, f in enumerate(found) if f is None]
        for s in range(0, len(rest), 4096):
            for i, e in zip(rest[s : s + 4096], self.library.encode_batch([texts[i] for i in rest[s : s + 4096]], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, np.uint32)
        sizes = np.array([len(f) for f in found], np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + total), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + total] = np.concatenate(found)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.used += total

    def encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[ends[i] : ends[i + 1]], one after another, and how many each has."""
        if len(self.codes) > CACHE_WORDS or self.used > CACHE_IDS:
            self.clear()
        codes, new = self.codes, []

        def code(word: bytes) -> int:
            c = codes.get(word)
            if c is None:
                c = codes[word] = len(codes)
                new.append(word)
            return c

        # special strings are told from their upper-case spellings, so such texts are not lower-cased here
        low = data if any(s in data or s in data.lower() for s in self.special) else data.lower()
        words, counts = [], np.zeros(len(ends) - 1, np.int64)
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            own = low[a:b].split()
            counts[i] = len(own)
            words.append(np.fromiter(map(code, own), np.int64, len(own)))
        if new:
            self._keep(new)
        at = np.concatenate([*words, np.zeros(0, np.int64)])
        sizes = self.lengths[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.starts[at] - before[:-1], sizes)]
        doc = np.concatenate([[0], np.cumsum(counts)])
        if len(new) and max(map(len, new)) > CACHE_BYTES << 10:
            self.clear()  # a very long word is not kept
        return ids, np.diff(before[doc])


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each vocabulary and worker process."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


class Cutter:
    """Cuts a stream of documents' ids into sequences; the last, open one waits for more."""

    def __init__(self, length: int, kind: pa.DataType, first: int):
        self.length, self.next = length, first
        self.ids = np.zeros(0, np.uint32)
        #: of the documents that lie in ids: their names, ids before these, all ids, and where they begin in ids
        self.names, self.start, self.total, self.at = pa.array([], kind), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        """The pieces of all sequences that are full now."""
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, np.zeros(len(sizes), np.int64)])
        self.total = np.concatenate([self.total, sizes])
        self.names = pa.concat_arrays([self.names, names])
        full = len(self.ids) // self.length
        out = self._pieces(np.arange(full) * self.length, full * self.length)
        self.next += full
        done = full * self.length
        ends = np.append(self.at[1:], len(self.ids))
        left = ends > done
        self.start = self.start[left] + np.maximum(done - self.at[left], 0)
        self.at = np.maximum(self.at[left] - done, 0)
        self.total, self.names, self.ids = self.total[left], self.names.filter(pa.array(left)), self.ids[done:].copy()
        return out

    def close(self) -> pa.RecordBatch:
        """What is left as sequences whose lengths are powers of two, the longest first: those are not padded."""
        n, cuts = len(self.ids), [0]
        while cuts[-1] < n:
            cuts.append(cuts[-1] + (1 << (n - cuts[-1]).bit_length() - 1))
        return self._pieces(np.array(cuts[:-1], np.int64), n)

    def _pieces(self, starts: np.ndarray, end: int) -> pa.RecordBatch:
        """Pieces of ids[:end], cut at documents and at the starts of sequences."""
        cuts = np.unique(np.concatenate([self.at[self.at < end], starts]))
        sizes = np.diff(np.append(cuts, end))
        doc = np.searchsorted(self.at, cuts, "right") - 1
        sequence = np.searchsorted(starts, cuts, "right") - 1
        edges = np.append(cuts, end).astype(np.int32) * 4
        data = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(self.ids[:end].astype("<u4").tobytes())])
        rows = [self.start[doc] + cuts - self.at[doc], sizes, self.total[doc], self.next + sequence, cuts - starts[sequence]]
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(doc)), *[pa.array(r, pa.int64()) for r in rows], data], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids for every piece of a row of docs (doc_id of any type, text):
    its ids from start on (of doc_tokens, with end_id behind them) lie in that sequence from offset on. ids holds them as
    little-endian unsigned 32-bit numbers.

    vocabulary: path of a lower-case word BPE tokenizer .json, present on every node; ids are the library's, without special
    tokens added. Documents follow a Hilbert curve through their projected gram vectors, and a sequence takes them up one after
    another, so that neighbours share one; a document is cut only where a sequence is full. Every sequence has `length` ids but
    the last few of a partition, which have powers of two and so need no padding either.

    A null or empty text has end_id alone. Repeated rows are documents of their own. Rows with equal texts lie next to each other
    on the curve, yet are dealt by a hash of their ids as well, so copies do not gather in one task. Whole texts count, however
    long. Other columns are ignored, whatever their names; an empty table gives an empty result. One shuffle, by ranges of the
    key; a task tokenizes and cuts its range as a stream.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    @F.arrow_udf("long")
    def key(text: pa.Array) -> pa.Array:
        data, ends = utf8_slices(text)
        return pa.array(hilbert(projected(data, ends)))

    placed = docs.select("doc_id", "text", key("text").alias("key"), F.xxhash64("doc_id").alias("salt"))
    sorted_ = placed.repartitionByRange(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cutter = word_ids(vocabulary), None
        for batch in batches:
            if cutter is None:
                cutter = Cutter(length, batch.column(0).type, TaskContext.get().partitionId() << 32)
            raw, ends = utf8_slices(batch.column(1))
            steps = np.append(np.nonzero(np.diff(ends[:-1] // STEP, prepend=-1))[0], len(ends) - 1) if len(ends) > 1 else []
            for a, b in zip(steps[:-1], steps[1:], strict=True):
                ids, sizes = words.encode(raw[ends[a] : ends[b]].tobytes(), ends[a : b + 1] - ends[a])
                after = np.cumsum(sizes)
                yield cutter.add(batch.column(0).slice(a, b - a), np.insert(ids, after, end_id), sizes + 1)
        if cutter is not None:
            yield cutter.close()

    pieces = sorted_.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (array<long>), pieces (array of doc_id, start, length in their order) for every sequence of pack(). A
    sequence has as many ids as pack() was told at most, so no group is large."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    own = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    number = "aggregate(reverse(sequence(0, 3)), 0L, (t, b) -> t * 256 + conv(hex(substring(p.ids, 4 * i + b + 1, 1)), 16, 10))"
    ids = f"flatten(transform(p, p -> transform(sequence(0, int(p.length) - 1), i -> {number})))"
    return own.select("sequence_id", F.expr(ids).alias("ids"), F.expr("transform(p, p -> struct(p.doc_id, p.start, p.length))").alias("pieces"))
