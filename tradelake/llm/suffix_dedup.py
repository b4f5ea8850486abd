"""Suffix dedup: bytes of 50-byte strings that also start in a document with a smaller id, by radix passes.

Suffixes are ordered only through WINDOW bytes, by most-significant-digit passes, and equal groups are the repeats.
Moving every suffix of the corpus would take many times its size, so the first pass moves a sample of them that
loses none: in each window the string of GRAM bytes with the smallest hash (leftmost of equals) is its anchor, so equal
windows have equal anchors, and neighbouring windows share one. The windows of one anchor form a block of text.

  pass 1  digits: the 24 bytes at the anchor, 8 at a time, then a digest of the block. Blocks equal to one in a smaller
          document are covered whole. Anchors with more than one block go on.
  pass 2  digits: the 50 bytes of every window of those blocks, 8 at a time, turned so that the anchor comes first (which
          keeps windows of one anchor together) and then its place. Windows that also start in a smaller document are
          covered.

In both passes the shuffle is the leading digits: a bucket is a range of byte strings in order, cut at quantiles of a
sample so that buckets are of one size (which changes the cost and no result), and there are as many as the data need.
Within a bucket the passes go on over the later digits, and only what is still tied takes part. Each task first combines
what it has, so a string in very many documents is sent once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, partitions, utf8_slices, with_long_id

WINDOW, GRAM = 50, 24
#: Bytes of text that are anchored at once, pieces and windows that are sorted together before they are sent.
PIECE, PIECES, ENTRIES = 1 << 19, 5, 150_000
#: Bytes of entries in a bucket and read by a task (about), ranges that are cut from the sample, and bytes of it.
BUCKET, TASK, RANGES, SAMPLE = 8_000_000, 16_000_000, 4096, 4_000_000
#: Tasks of a pass at most; beyond that they read more, but never hold more than a bucket.
TASKS = 50_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_REPLY = "doc long, start long, length int, anchor int, open boolean"
#: Bytes of an entry beside its key: document, start, length, offset of the anchor.
_ENTRY = 8 + 5 + 1 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


def _ladder(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 8-, 16- and 32-byte strings at every position."""
    h, out, size = _mix(data.astype(np.uint64) + np.uint64(1)), {}, 1
    while size < 32 and len(h) > size:
        h = _mix(h[:-size] * _M2 + h[size:])
        size *= 2
        if size >= 8:
            out[size] = h
    return out


def _string_hash(h32: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the bytes at start, by three 32-byte strings that cover them (32 < length <= 96)."""
    a, b, c = h32[start], h32[start + (length - 32) // 2], h32[start + length - 32]
    return _mix(_mix(_mix(a * _M2 + b) * _M3 + c) + length.astype(np.uint64))


def anchored_blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, block digest, block start, block length) for all anchors of the texts that end at ends."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < WINDOW:
        return none
    hashes = _ladder(data)
    n = len(data) - GRAM + 1
    low, at, size = _mix(hashes[16][:n] * _M3 + hashes[8][16 : 16 + n]), np.arange(n, dtype=np.int32), 1
    width = WINDOW - GRAM + 1
    while size < width:
        step = min(size, width - size)
        left, right = low[:-step], low[step:]
        at = np.where(right < left, at[step:], at[:-step])
        low = np.minimum(left, right)
        size += step
    starts = len(data) - WINDOW + 1
    at = at[:starts]
    ok = np.ones(starts, bool)
    for e in ends[:-1].tolist():  # windows that would cross into the next text
        ok[max(0, e - WINDOW + 1) : min(e, starts)] = False
    where = np.nonzero(ok)[0]
    if not len(where):
        return none
    own = at[where]
    new = np.nonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (where[1:] != where[:-1] + 1)]))[0]
    first, last = where[new], where[np.concatenate([new[1:] - 1, [len(where) - 1]])]
    length = last - first + WINDOW
    return own[new].astype(np.int64), _string_hash(hashes[32], first, length), first, length


def grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The GRAM bytes at each position as big-endian words of 8 bytes."""
    return data[at[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64)


def windows_at(data: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The window at each position as big-endian words of 8 bytes: its bytes from the anchor on, those before it, and the
    anchor's offset; filled up with zeros."""
    out = np.zeros((len(at), -(-(WINDOW + 1) // 8) * 8), np.uint8)
    turned = (np.arange(WINDOW)[:, None] + np.arange(WINDOW)) % WINDOW
    for s in range(0, len(at), 1 << 14):  # the index is eight times the text
        e = s + (1 << 14)
        out[s:e, :WINDOW] = data[at[s:e, None] + turned[anchor[s:e]]]
    out[:, WINDOW] = anchor
    return out.view(">u8").astype(np.uint64)


def radix_groups(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words by most-significant-digit passes, a word being a digit, and where in that order a group of
    equal rows begins. Rows that a pass has told from all others take no part in the next."""
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    head = np.concatenate([[True], first[1:] != first[:-1]])[: len(order)]
    for d in range(1, words.shape[1]):
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.nonzero(tied)[0]
        if not len(at):
            break
        group, digit = np.cumsum(head)[at], words[order[at], d]
        inner = np.lexsort((digit, group))
        order[at], digit = order[at][inner], digit[inner]
        head[at[1:]] |= (digit[1:] != digit[:-1]) & (group[1:] == group[:-1])
    return order, head


def _keys(words: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings, which compare like the rows."""
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()


class Ranges:
    """Buckets of byte strings in order: ranges between cuts, and each range dealt by a hash of the first words."""

    def __init__(self, sample: np.ndarray, buckets: int, words: int):
        ranges = min(buckets, RANGES)
        order = np.sort(_keys(sample)) if len(sample) else np.zeros(0, f"S{8 * words}")
        self.cuts = np.unique(order[np.linspace(0, len(order), ranges + 1)[1:-1].astype(int)]) if len(order) else order
        self.deal = -(-buckets // ranges)

    def of(self, words: np.ndarray, leading: int) -> np.ndarray:
        bucket = np.searchsorted(self.cuts, _keys(words), side="right").astype(np.int64)
        if self.deal == 1:
            return bucket
        h = np.zeros(len(words), np.uint64)
        for d in range(leading):
            h = _mix(h * _M2 + words[:, d])
        return bucket * self.deal + (h % np.uint64(self.deal)).astype(np.int64)

    def split(self, leading: int) -> np.ndarray:
        """The first words of the cuts: what begins like one may lie in several buckets."""
        return np.unique(np.array([c[: 8 * leading] for c in (x.ljust(8 * leading, b"\0") for x in self.cuts.tolist())], f"S{8 * leading}"))


def _bytes(values: np.ndarray, size: int, kind: str = ">u8") -> np.ndarray:
    """The last size bytes of each value, most significant first."""
    return values.astype(kind).view(np.uint8).reshape(-1, 8)[:, 8 - size :]


def _text_words(width: int) -> int:
    """How many words of a key are text: an anchor's key ends with a digest, a window's does not."""
    return min(width, GRAM // 8) if width == GRAM // 8 + 1 else width


def _packed(words: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Compressed keys row by row, then the bytes of the other columns one after the other: what changes slowly lies together."""
    columns = [_bytes(doc, 8, ">i8"), _bytes(start, 5), _bytes(length, 1), _bytes(anchor, 1)]
    text, rest = words[:, : _text_words(words.shape[1])], words[:, _text_words(words.shape[1]) :]
    return pack.compress(text.astype(">u8").tobytes() + rest.astype(">u8").tobytes() + np.concatenate(columns, axis=1).T.tobytes())


def _unpacked(blobs: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(words, doc, start, length, anchor) of packed rows with keys of width words."""
    out, unpack = [], zstandard.ZstdDecompressor()
    own = _text_words(width)
    for blob in blobs:
        raw = np.frombuffer(unpack.decompress(blob), np.uint8)
        n = len(raw) // (8 * width + _ENTRY)
        text, rest = raw[: 8 * own * n].view(">u8").reshape(n, own), raw[8 * own * n : 8 * width * n].view(">u8").reshape(n, width - own)
        m = raw[8 * width * n :].reshape(_ENTRY, n)
        full = np.zeros((2, n, 8), np.uint8)
        full[0], full[1, :, 3:] = m[:8].T, m[8:13].T
        numbers = full.view(">i8")[:, :, 0].astype(np.int64)
        out.append((np.concatenate([text, rest], axis=1).astype(np.uint64), numbers[0], numbers[1], m[13].astype(np.int64), m[14].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, length) of the maximal runs of ranges that overlap or touch."""
    if not len(doc):
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + length)[order]
    other = np.concatenate([[True], doc[1:] != doc[:-1]])
    big = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + np.cumsum(other) * big) - np.cumsum(other) * big
    new = np.nonzero(other | np.concatenate([[True], start[1:] > reach[:-1]]))[0]
    return doc[new], start[new], reach[np.concatenate([new[1:] - 1, [len(doc) - 1]])] - start[new]


def _reply(doc: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    """Covered ranges, or with an anchor those that go on."""
    open_ = anchor is not None
    columns = [pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(anchor.astype(np.int32)) if open_ else pa.nulls(len(doc), pa.int32()), pa.array(np.full(len(doc), open_))], ["doc", "start", "length", "anchor", "open"])


def _lowest(doc: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each row the smallest document of its group."""
    return np.minimum.reduceat(doc, np.nonzero(head)[0])[np.cumsum(head) - 1]


def _digit_pass(entries: DataFrame, split: Callable, ranges: Ranges, width: int, leading: int, tasks: int, name: str, blocks: bool) -> DataFrame:
    """(doc, start, length, anchor, open): covered ranges, and with blocks those that go on to the next pass (open).

    split turns the batches of entries into (words, doc, start, length, anchor) arrays with keys of width words, of which
    the leading ones are the anchor's.
    """
    sent_ranges = entries.sparkSession.sparkContext.broadcast(ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket's entries, of the smallest document here for each key. The others are covered for certain and
        need no meeting: they go, as whole runs, to no bucket (-1) and stay spread."""
        own, pack = sent_ranges.value, zstandard.ZstdCompressor(level=1)
        spread = 0
        for arrays in split(batches):
            if not len(arrays[1]):
                continue
            order, head = radix_groups(arrays[0])
            words, doc, start, length, anchor = (x[order] for x in arrays)
            over = doc != _lowest(doc, head)
            rows = []
            if over.any():
                d, s, n = _spans(doc[over], start[over], length[over])
                rows.append((-1, int(d[0]) + spread, np.stack([d, s, n]).tobytes()))
                spread += 1
            bucket = own.of(words[~over], leading)
            by = np.nonzero(~over)[0][np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket, kind="stable")
            cuts = [0, *(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1).tolist(), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(bucket[a]), int(bucket[a]), _packed(*(x[by[a:b]] for x in (words, doc, start, length, anchor)), pack)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "place", "blob"])

    def met(blobs: list[bytes], several: np.ndarray) -> Iterator[pa.RecordBatch]:
        arrays = _unpacked(blobs, width)
        order, head = radix_groups(arrays[0])
        words, doc, start, length, anchor = (x[order] for x in arrays)
        over = doc != _lowest(doc, head)
        yield _reply(doc[over], start[over], length[over])
        if blocks:
            first = np.nonzero(head)[0]
            gram = np.zeros(len(doc), bool)
            gram[first] = np.concatenate([[True], (words[first[1:], :leading] != words[first[:-1], :leading]).any(1)])
            at = np.nonzero(gram)[0]
            going = np.add.reduceat(head.astype(np.int64), at) > 1
            going &= np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            going |= np.isin(_keys(words[at, :leading]), several)
            going = ~over & going[np.cumsum(gram) - 1]
            yield _reply(doc[going], start[going], length[going], anchor[going])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket; only one bucket is held at a time."""
        several = sent_ranges.value.split(leading)
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    yield _reply(*np.frombuffer(blob.as_buffer(), np.int64).reshape(3, -1))
                    continue
                if bucket != now and blobs:
                    yield from met(blobs, several)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from met(blobs, several)

    sent = entries.mapInArrow(send, "bucket long, place long, blob binary")
    placed = sent.repartition(tasks, "place").sortWithinPartitions("bucket").select("bucket", "blob")
    return materialise(placed.mapInArrow(meet, _REPLY), name)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (bytes, ends, doc of each text, offset of each text in its document) of about PIECE bytes; a longer text comes
    in parts that overlap by a window less a byte."""
    held, size = [], 0

    def run() -> tuple[np.ndarray, ...]:
        return np.concatenate([h[2] for h in held]), np.cumsum([len(h[2]) for h in held]), np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)

    for batch in batches:
        data, ends = utf8_slices(batch.column(1))
        for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            for s in range(a, max(a + 1, b - WINDOW + 1), PIECE):
                part = data[s : min(b, s + PIECE + WINDOW - 1)]
                if len(part) >= WINDOW:
                    held.append((doc, s - a, part.copy()))
                    size += len(part)
                    if size >= PIECE:
                        yield run()
                        held, size = [], 0
    if held:
        yield run()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    held: list[tuple[np.ndarray, ...]] = []
    for data, ends, doc, offset in _pieces(batches):
        at, digest, first, length = anchored_blocks(data, ends)
        row = np.searchsorted(ends, first, side="right")
        base = np.concatenate([[0], ends[:-1]])
        held.append((np.column_stack([grams_at(data, at), digest]), doc[row], first - base[row] + offset[row], length, at - first))
        if len(held) >= PIECES:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """All windows of the blocks of the documents (doc, text, blocks)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        data, ends = utf8_slices(batch.column(1))
        lists = batch.column(2)
        begin, length, anchor = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        # rows of one id may differ in length, so a block may not fit
        count = np.maximum(0, np.minimum(length, ends[row + 1] - ends[row] - begin) - WINDOW + 1)
        total = np.cumsum(count)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ENTRIES, side="right")))
            c = count[lo:hi]
            step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            start, own = step + np.repeat(begin[lo:hi], c), np.repeat(row[lo:hi], c)
            held.append((windows_at(data, ends[own] + start, np.repeat(anchor[lo:hi], c) - step), docs[own], start, np.full(len(start), WINDOW), np.zeros(len(start), np.int64)))
            size, lo = size + len(start), hi
            if size >= ENTRIES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def covered_ranges(rows: DataFrame) -> DataFrame:
    """(doc, start, length) byte ranges of rows (doc long, text) to remove; ranges may overlap."""
    spark = rows.sparkSession
    rows = rows.where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = int(total) * (GRAM + 8 + _ENTRY) // ((WINDOW - GRAM + 2) // 2)
    tasks = max(partitions(spark), min(TASKS, -(-size // TASK)))
    buckets = max(4 * tasks, -(-size // BUCKET))
    # only for the cuts between buckets, so what one text adds is bounded
    some = rows.sample(min(1.0, SAMPLE / max(1, total)), 1).limit(SAMPLE // 100).select(F.left("text", F.lit(PIECE)).alias("text")).toArrow()
    grams, strings = [np.zeros((0, 4), np.uint64)], [np.zeros((0, 7), np.uint64)]
    for data, ends, _, _ in _pieces(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int64)), b.column(0)], ["doc", "text"]) for b in some.to_batches()):
        at, digest, first, _ = anchored_blocks(data, ends)
        grams.append(np.column_stack([grams_at(data, at), digest]))
        strings.append(windows_at(data, first, at - first))
    first = _digit_pass(rows, _anchors, Ranges(np.concatenate(grams), buckets, 4), 4, 3, tasks, "suffix-blocks", True)
    going = first.where("open").groupBy("doc").agg(F.collect_list(F.struct("start", "length", "anchor")).alias("blocks"))
    again = rows.join(going.hint("merge"), "doc").select("doc", "text", "blocks")
    second = _digit_pass(again, _windows, Ranges(np.concatenate(strings), buckets, 7), 7, 7, tasks, "suffix-windows", False)
    return first.where("not open").unionByName(second).select("doc", "start", "length")


def remove_ranges(docs: DataFrame, ranges: DataFrame, doc: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text, doc) once the ranges are cut out."""
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("ranges")).withColumnRenamed("doc", doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8_slices(batch.column(1))
            out = []
            for a, b, cuts in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(2), strict=True):
                text = data[a:b].tobytes()
                spans = merged_spans(cuts.values, b - a) if cuts.is_valid else []
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                out.append((b - a, sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([o[3] for o in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = docs.join(lists.hint("merge"), doc, "left").select("doc_id", "text", "ranges")
    return marked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merged_spans(ranges: pa.StructArray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the ranges (start, length), within size bytes."""
    start, length = (ranges.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    length = np.minimum(length, size - start)
    good = length > 0
    _, start, length = _spans(np.zeros(int(good.sum()), np.int64), start[good], length[good])
    return list(zip(start.tolist(), (start + length).tolist(), strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id of any type, text).

    Every byte that lies in a 50-byte string which also starts in a document with a smaller doc_id is removed; the
    strings are those of the input. Texts are UTF-8 bytes, null is empty; a null doc_id counts as smaller than any.
    doc_id names a document: rows that share one never cover each other, and what is found in one of them holds for
    all. Windows are compared byte by byte; blocks that are covered whole agree in the 24 bytes at their anchor, in length
    and in 64 bits of hash. Long texts are worked on in overlapping pieces. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    own = fresh(docs, "doc")
    keyed = with_long_id(docs.select("doc_id", "text"), own)
    return remove_ranges(keyed, covered_ranges(keyed.select(F.col(own).alias("doc"), "text")), own)
