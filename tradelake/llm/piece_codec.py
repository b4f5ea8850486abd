"""SentencePiece encoding and decoding of BPE piece models by suffix-array matching.

The new words of a batch are concatenated and indexed by a suffix array; every piece of the model is looked up in
it by binary search, and each occurrence is an edge (start, length, rank) over the text. The edges, sorted by
position, are then relaxed: a word's symbols are merged over the best remaining edge until none is left. A
longest-path relaxation would give the result of a unigram model; for a BPE model only this order is right.

A very long unbroken word is indexed in overlapping parts of fixed size, and its edges are relaxed in the order of their
positions with one piece kept for each position: the last piece of the encoding of the text up to there. That is the only
one whose pair with the piece before it is an encoding itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keep, tidy

SPACE = "▁"
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: Code points that are indexed at once; words up to LOCKSTEP_CHARS are relaxed together; longer words than LONG_CHARS are
#: relaxed by position. All change the cost and no result.
INDEX_CHARS, LOCKSTEP_CHARS, LONG_CHARS = 80_000, 64, 100_000
#: Ids that are decoded at once, and pairs of pieces that a worker remembers.
DECODED, PAIRS = 1 << 18, 1 << 20
NO_EDGE = 2**30


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (small non-negative integers) in the order of their suffixes, told apart to depth symbols.

    Prefix doubling; the first key holds as many symbols as fit."""
    n = len(text)
    symbols, code = np.unique(text, return_inverse=True)
    width = max(1, int(len(symbols)).bit_length())
    h = max(1, min(depth, 62 // width))
    padded = np.concatenate([code.astype(np.int64) + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << width | padded[k : k + n]
    while True:
        order = np.argsort(key)
        if h >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n:
            return order
        second = np.zeros(n, np.int64)
        if h < n:
            second[: n - h] = rank[h:]
        key = rank * (n + 1) + second
        h *= 2


class PieceModel:
    """The pieces of a model, the words seen so far with their ids, and both directions of the codec."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.ascii_id = np.array([self.byte_id[b] for b in range(128)], np.int32)
        normal = [i for i in ids if i not in self.special and i not in self.bytes]
        score = {i: sp.get_score(i) for i in normal}
        if any("\0" in self.pieces[i] for i in normal):
            raise ValueError("a piece holds NUL, which separates words here")
        #: Pieces by falling score; equal scores share a rank, so that the leftmost merge goes first.
        by_score = sorted(normal, key=lambda i: -score[i])
        self.order, self.rank, last = np.array(by_score, np.int64), np.zeros(len(by_score), np.int64), None
        for k, i in enumerate(by_score):
            self.rank[k] = self.rank[k - 1] + (score[i] != last) if k else 0
            last = score[i]
        self.width = max(len(self.pieces[i]) for i in normal)
        self.needles = np.zeros((len(by_score), self.width), ">u4")
        for k, i in enumerate(by_score):
            self.needles[k, : len(self.pieces[i])] = np.frombuffer(self.pieces[i].encode("utf-32-le"), "<u4") + 1
        self.lengths = (self.needles != 0).sum(1).astype(np.int64)
        #: Words end before a space mark, unless a piece crosses such a place.
        inner = any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal)
        self.split = regex.compile(f"(?s){SPACE}(.*)" if inner else f"{SPACE}({SPACE}*[^{SPACE}]+|{SPACE}*)")
        self.whole = inner
        self.words: dict[str, bytes] = {}
        self.number = {self.pieces[i]: int(self.rank[k]) for k, i in enumerate(by_score)}
        self.name = {self.pieces[i]: i for i in normal}
        self.pairs: dict[int, bool] = {}
        #: What an id stands for; bytes beyond ASCII only mean something together.
        self.text = [chr(self.bytes[i]) if i in self.bytes else "" if i in self.special else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.high = np.array([self.bytes.get(i, 0) > 127 for i in ids])

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The joined words, and all piece occurrences in them: start (by joined position, in order), length, rank, piece id."""
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int64) + 1
        start = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        text[np.array([s + len(w) for s, w in zip(start.tolist(), words, strict=True)])] = 0
        suffixes = suffix_array(text, self.width)
        padded = np.concatenate([text, np.zeros(self.width, np.int64)]).astype(">u4")
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[suffixes])
        keys = keys.view(f"S{4 * self.width}").ravel()
        low = np.searchsorted(keys, np.ascontiguousarray(self.needles).view(f"S{4 * self.width}").ravel())
        top = self.needles.copy()
        top[np.arange(self.width)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        high = np.searchsorted(keys, top.view(f"S{4 * self.width}").ravel())
        # a piece of full width has no room for the upper bound's filling
        full = np.nonzero(self.lengths == self.width)[0]
        if len(full):
            high[full] = np.searchsorted(keys, self.needles[full].copy().view(f"S{4 * self.width}").ravel(), side="right")
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        order = np.argsort(at)
        which, at = which[order], at[order]
        return text, at, self.lengths[which], self.rank[which], self.order[which]

    def relax(self, word: str, edges: dict[tuple[int, int], tuple[int, int]]) -> bytes:
        """The ids of a word: adjacent symbols merge over the edge of the best rank, leftmost first."""
        n = len(word)
        end, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(e[0], i, i + 1, i + 2) for i in range(n - 1) if (e := edges.get((i, 2)))]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < n:
                prv[k] = i
                if e := edges.get((i, end[k] - i)):
                    heapq.heappush(heap, (e[0], i, k, end[k]))
            if (p := prv[i]) >= 0 and (e := edges.get((p, k - p))):
                heapq.heappush(heap, (e[0], p, i, k))
        out, i = [], 0
        while i < n:
            if e := edges.get((i, end[i] - i)):
                out.append(e[1])
            else:
                out += [self.byte_id[b] for b in word[i : end[i]].encode()]
            i = end[i]
        return np.array(out, np.int32).tobytes()

    def is_encoding(self, a: int, b: int) -> bool:
        """Whether the text of piece a (-1: none) and then of piece b is encoded as just these."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        left, right = self.pieces[a] if a >= 0 else "", self.pieces[b]
        word = left + right
        edges = {(i, n): (r, self.name[word[i : i + n]]) for i in range(len(word)) for n in range(1, len(word) - i + 1) if (r := self.number.get(word[i : i + n])) is not None}
        want = np.array([a, b] if a >= 0 else [b], np.int32).tobytes()
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        out = self.pairs[key] = self.relax(word, edges) == want
        return out

    def relax_by_position(self, word: str) -> bytes:
        """The ids of a long word, from its edges in parts of INDEX_CHARS."""
        n = len(word)
        last = np.full(n + 1, -2, np.int32)  # -2: not reached, -1: a character without a piece, or the start
        last[0] = -1
        for s in range(0, n, INDEX_CHARS):
            part = word[s : s + INDEX_CHARS + self.width]
            _, at, length, _, piece = self.edges([part])
            own = at < INDEX_CHARS
            begin = np.searchsorted(at[own], np.arange(min(INDEX_CHARS, n - s) + 1)).tolist()
            length, piece = length[own].tolist(), piece[own].tolist()
            reached = last[s : s + len(part) + 1].tolist()
            for i in range(len(begin) - 1):
                before, alone = reached[i], True
                for j in range(begin[i], begin[i + 1]):
                    e, p = i + length[j], piece[j]
                    alone &= length[j] > 1
                    if e < len(reached) and reached[e] == -2 and self.is_encoding(before, p):
                        reached[e] = p
                if alone:
                    reached[i + 1] = -1
            last[s : s + len(part) + 1] = reached
        out, held, i = [], [], n
        while i > 0:
            p = int(last[i])
            if p >= 0:
                held.append(p)
                i -= len(self.pieces[p])
            else:
                held += [self.byte_id[b] for b in word[i - 1].encode()[::-1]]
                i -= 1
            if len(held) >= DECODED or i <= 0:
                out.append(np.array(held[::-1], np.int32).tobytes())
                held = []
        return b"".join(out[::-1])

    def learn(self, bare: list[str]) -> dict[str, bytes]:
        """The ids of words that are not known yet; a word comes without its first space mark."""
        out: dict[str, bytes] = {}
        if not bare:
            return out
        words = [SPACE + w for w in bare]
        text, at, length, rank, piece = self.edges(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        size = np.diff(starts) - 1
        short = np.nonzero(size <= LOCKSTEP_CHARS)[0]
        done = self.relax_together(text, starts[:-1][short], size[short], at, length, rank, piece)
        for k, ids in zip(short.tolist(), done, strict=True):
            if ids is not None:
                out[bare[k]] = ids
        left = [k for k in range(len(words)) if bare[k] not in out]
        cut = np.searchsorted(at, starts)
        for k in left:
            a, b, s = int(cut[k]), int(cut[k + 1]), int(starts[k])
            near = zip((at[a:b] - s).tolist(), length[a:b].tolist(), rank[a:b].tolist(), piece[a:b].tolist(), strict=True)
            out[bare[k]] = self.relax(words[k], {(i, n): (r, p) for i, n, r, p in near})
        return out

    def relax_together(self, text, starts, size, at, length, rank, piece) -> list[bytes | None]:
        """relax() for many words in lockstep: each round merges the best edge of every word that still has one.
        None for a word that needs byte pieces of a character of several bytes."""
        if not len(starts):
            return []
        best = np.full((len(text), self.width + 1), NO_EDGE, np.int32)
        best[at, length] = rank
        name = np.full((len(text), self.width + 1), -1, np.int32)
        name[at, length] = piece
        word = np.repeat(np.arange(len(starts)), size)
        begin = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        end, ended = begin + 1, []
        while len(word):
            n = end[1:] - begin[:-1]
            fits = (word[1:] == word[:-1]) & (n <= self.width)
            score = np.full(len(word), NO_EDGE, np.int64)
            score[:-1][fits] = best[begin[:-1][fits], n[fits]]
            first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            least = np.minimum.reduceat((score << 32) | np.arange(len(word)), first)
            open_ = (least >> 32) < NO_EDGE
            where = (least & 0xFFFFFFFF)[open_]
            end[where] = end[where + 1]
            stays = np.ones(len(word), bool)
            stays[where + 1] = False
            going = np.repeat(open_, np.diff(np.concatenate([first, [len(word)]])))
            over = stays & ~going
            ended.append((word[over], begin[over], name[begin[over], end[over] - begin[over]]))
            stays &= going
            word, begin, end = word[stays], begin[stays], end[stays]
        word, begin, ids = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(begin, kind="stable")
        word, begin, ids = word[order], begin[order], ids[order]
        alone = np.nonzero(ids < 0)[0]  # characters without a piece
        ascii_ = alone[text[begin[alone]] <= 128]  # text holds code points plus one
        ids[ascii_] = self.ascii_id[text[begin[ascii_]] - 1]
        lacking = np.zeros(len(starts), bool)
        lacking[word[ids < 0]] = True
        raw, cut = ids.astype("<i4").tobytes(), (4 * np.searchsorted(word, np.arange(len(starts) + 1))).tolist()
        return [None if bad else raw[a:b] for bad, a, b in zip(lacking.tolist(), cut[:-1], cut[1:], strict=True)]

    def words_of(self, text: str | None) -> list[str]:
        """The words of a text, each without its first space mark (encoding puts one before the text)."""
        if not text:
            return []
        if not self.whole and SPACE not in text and "" not in (words := text.split(" ")):
            return words
        return self.split.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        split = [self.words_of(t) for t in texts]
        known, fresh, size, now = self.words, [], 0, {}
        for w in {w for ws in split for w in ws}.difference(known):
            if len(w) > LONG_CHARS:
                now[w] = self.relax_by_position(SPACE + w)
                continue
            fresh.append(w)
            size += len(w) + 2
            if size >= INDEX_CHARS:
                now |= self.learn(fresh)
                fresh, size = [], 0
        now |= self.learn(fresh)
        known.update(now)
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        else:
            for w in now:
                if len(w) > CACHE_CHARS:
                    del known[w]
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8, without the leading space that encoding adds."""
        ids = np.asarray(ids, np.int64)
        out, a = [], 0
        while a < len(ids):
            b = min(len(ids), a + DECODED)
            while b < len(ids) and int(ids[b]) in self.bytes:  # bytes only mean something together
                b += 1
            out.append(self._decoded(ids[a:b]))
            a = b
        return "".join(out).removeprefix(" ")

    def _decoded(self, ids: np.ndarray) -> str:
        if not self.high[ids].any():
            return "".join(map(self.text.__getitem__, ids.tolist()))
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)


def model(path: str) -> PieceModel:
    """One model per file and worker process."""
    return keep(("pieces", path), lambda: PieceModel(path))


def encode_pieces(docs: DataFrame, model_path: str, column: str = "text", verify: bool = False) -> DataFrame:
    """docs with an added column piece_ids (array<int>): the library's encoding, without begin or end marks.

    A null text gives null, an empty one no ids. Repeated rows are encoded alike. Columns of docs with the added
    names are replaced, others kept whatever their names; an empty table gives an empty result. Whole texts are encoded,
    however long: a text in one unbroken word takes a few bytes of memory a character. Rows are independent: no shuffle. model_path is read on every node. With verify there are
    also n_pieces (0 for null) and decodes_back: whether decoding the ids gives the text again (the model keeps no
    difference between a space and its space mark, so both count as a space).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for part in _parts(batch, column):
                texts = part.column(column).to_pylist()
                raw = m.encode(texts)
                ends = np.cumsum([0] + [len(r) // 4 for r in raw])
                flat = np.frombuffer(b"".join(raw), np.int32)
                added = {"piece_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))}
                if verify:
                    same = [m.decode(flat[a:b]) == (t or "").replace(SPACE, " ") for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
                    added |= {"n_pieces": pa.array(np.diff(ends), pa.int64()), "decodes_back": pa.array(same, pa.bool_())}
                yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], [*part.schema.names, *added])

    names = ["piece_ids", "n_pieces", "decodes_back"] if verify else ["piece_ids"]
    rows = docs.drop(*names)
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()]
    return rows.mapInArrow(tidy(run, ("pieces", model_path)), T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]]))


def decode_pieces(encoded: DataFrame, model_path: str, column: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """encoded with an added string column: the text of its id arrays (null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            lists = batch.column(column)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + [len(x) if x.is_valid else 0 for x in lists])
            valid = lists.is_valid().to_pylist()
            texts = [m.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    rows = encoded.drop(into)
    return rows.mapInArrow(tidy(run, ("pieces", model_path)), T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def _parts(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most about so many bytes of text."""
    sizes = [len(s.as_buffer()) if s.is_valid else 0 for s in batch.column(column)]
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
