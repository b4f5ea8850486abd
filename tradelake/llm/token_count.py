"""Token counts of byte-level BPE vocabularies by heap-and-linked-list merging; no token ids are produced."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that the byte-level pre-tokenizer of this family uses when its file names no other.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens whose counts a worker keeps, and the longest that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file, by rule: printable bytes stand
    for themselves and the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def check_spec(spec: dict) -> None:
    """Raise ValueError if a tokenizer file asks for a step that BpeCounter does not take."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [
        name
        for name, bad in (
            ("normalizer", bool(spec.get("normalizer"))),
            ("pre_tokenizer", pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True)),
            ("model", model.get("type", "BPE") != "BPE" or bool(model.get("dropout")) or bool(model.get("ignore_merges")) or bool(model.get("continuing_subword_prefix")) or bool(model.get("end_of_word_suffix"))),
            ("added_tokens", any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"not supported: {', '.join(wrong)}")


class BpeCounter(dict):
    """Maps a pre-token to its number of tokens; computes what it does not hold."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        check_spec(spec)
        names = byte_symbols()
        number = {s: i for i, s in enumerate(names)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            new = number.setdefault(left + right, len(number))
            self.pairs[number[left] << 20 | number[right]] = (rank, new)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRETOKEN)

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges: the lowest-rank adjacent pair is popped again and again, leftmost first."""
        n = len(word)
        if n < 2:
            return n
        sym, nxt, prv, pairs = list(word), list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = []
        for i in range(n - 1):
            if found := pairs.get(sym[i] << 20 | sym[i + 1]):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j >= n or pairs.get(sym[i] << 20 | sym[j]) != (rank, new):
                continue  # one of the two symbols went into another merge
            sym[i], sym[j], left = new, -1, left - 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if found := pairs.get(new << 20 | sym[k]):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (p := prv[i]) >= 0 and (found := pairs.get(sym[p] << 20 | new)):
                heapq.heappush(heap, (found[0], p, found[1]))
        return left

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            total += sum(map(self.__getitem__, self.pattern.findall(part)))
        return total


_counters: dict[str, BpeCounter] = {}


def counter(path: str) -> BpeCounter:
    """One counter per vocabulary and worker process."""
    if path not in _counters:
        _counters[path] = BpeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text).

    vocabulary: path of a byte-level BPE tokenizer .json, present on every node. A null or empty text has zero
    bytes and tokens. Strings of added special tokens inside a text count as one token each. Repeated rows give
    repeated results; other columns are ignored, whatever their names; ids are of any type; an empty table gives an empty
    result. Whole texts are counted, however long. A vocabulary with a normalizer, another pre-tokenizer, or added tokens that
    strip blanks raises ValueError. Rows are independent: no shuffle, and a lost task reruns alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            tokens = [count(t) if t else 0 for t in map(lambda s: s.as_py(), batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
