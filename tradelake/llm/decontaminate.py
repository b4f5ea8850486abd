"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits has, cut into k + 1 pieces, one piece that occurs exactly. All
pieces of the items are found in one pass over a text, and each hit's neighbourhood is verified with the
bit-parallel edit distance of Myers, which holds a column of the distance matrix in two bit vectors. An item too short for
an edit is one piece, and must stand between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, materialise, tidy

#: Edits allowed as a share of an item's characters.
MAX_EDIT_SHARE = 0.05
#: Characters of items that are broadcast together; more items are scanned for in several passes.
BLOCK_CHARS = 4_000_000
_BLANKS = r"[\s ]+"


def normalised(column: str) -> F.Column:
    """Lower case, with runs of blanks as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), _BLANKS, " "))


def edit_budget(chars: int, share: float = MAX_EDIT_SHARE) -> int:
    return int(chars * share)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, text) of budget + 1 pieces of nearly equal length."""
    cuts = [round(i * len(item) / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


class Pattern:
    """An item as the bit masks of its characters."""

    def __init__(self, item: str):
        self.item, self.size, self.masks = item, len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.top, self.all = 1 << (self.size - 1), (1 << self.size) - 1

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the substring of text nearest to the item, the first of equals (Myers 1999)."""
        up, down, score, masks, full, top = self.all, 0, self.size, self.masks, self.all, self.top
        least, at = score, 0
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < least:
                    least, at = score, i
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
        return least, at


def _alone(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], share: float = MAX_EDIT_SHARE):
        self.patterns = [(i, Pattern(t), edit_budget(len(t), share)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, p, budget) in enumerate(self.patterns):
            for offset, piece in pieces(p.item, budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[object, int, int]]:
        """(item_id, distance, end) for every item within its budget somewhere in text: its nearest occurrence."""
        if not self.patterns or not text:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, int] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                _, p, budget = self.patterns[k]
                if not budget:
                    if k not in whole and _alone(text, end + 1 - size, end + 1):
                        whole[k] = end + 1
                    continue
                a = end + 1 - size - offset - budget
                b = a + p.size + 2 * budget
                near = spans.setdefault(k, [])
                if near and a <= near[-1][1]:
                    near[-1] = (min(a, near[-1][0]), max(b, near[-1][1]))
                else:
                    near.append((a, b))
        out = [(self.patterns[k][0], 0, end) for k, end in whole.items()]
        for k, near in spans.items():
            item, p, budget = self.patterns[k]
            best = None
            for a, b in near:
                a = max(0, a)
                exact = text.find(p.item, a, b)
                d, e = (0, exact + p.size - a) if exact >= 0 else p.best(text[a:b])
                if d <= budget and (best is None or d < best[0]):
                    best = (d, a + e)
            if best:
                out.append((item, *best))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The distinct items (id, normalised text) that are not blank, dealt by hash into blocks of about BLOCK_CHARS
    characters; the driver holds one block at a time."""
    items = benchmark.select("item_id", normalised("text").alias("item")).where(F.length("item") > 0).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block) if blocks > 1 else items
        yield [(r.item_id, r.item) for r in own.toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, distance, end for every row of docs (doc_id, text) and item of benchmark (item_id, text) that
    occurs in it with at most share * length edits: the nearest occurrence, end being its last position in the
    normalised text. Ids are of any type.

    Texts and items are lower-cased and blanks are run together. Null and empty texts have no hits, and neither have null
    and blank items; an item too short for an edit (below 20 characters at 5 %) must occur exactly, between word borders;
    items of one text all hit; of equally near occurrences the first counts; repeated rows hit each; null ids are kept.
    Whole texts are looked at, however long. Other columns are ignored, whatever their names; an empty table on either
    side gives an empty result. The items are dealt into blocks of bounded size; each is sent to the executors and is a
    scan of its own over docs, so that nothing is shuffled and no document is paired with an item without a common
    piece. With several blocks the hits of each are stored before the next is sent.
    """
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance int, `end` long"
    arrow = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.int32(), pa.int64()]
    texts = docs.where("text is not null").select("doc_id", normalised("text").alias("text"))
    parts, sent = [], None
    for items in _blocks(benchmark):
        if sent is not None:
            parts[-1] = materialise(parts[-1], "leaks")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for batch in batches:
                found = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for h in matcher.hits(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(arrow)], ["doc_id", "item_id", "distance", "end"])

        parts.append(texts.mapInArrow(tidy(run), schema))
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDIT_SHARE) -> DataFrame:
    """docs without the rows in which find_leaks() finds an item of benchmark; same columns, whatever their names.

    Every row is judged by its own text, so ids may be of any type, null or repeated, and nothing is shuffled. Null and
    empty texts stay; an empty benchmark takes nothing away. With several blocks of items what one leaves is stored before the
    next is sent, so a worker holds one block.
    """
    names = docs.columns
    left, stored, sent = docs, None, None
    for items in _blocks(benchmark):
        if sent is not None:
            before, stored = stored, materialise(left, "clean")
            sent.unpersist()
            discard(before)
            left = stored
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for batch in batches:
                clean = [not matcher.hits(t.as_py() or "") for t in batch.column(0)]
                yield pa.RecordBatch.from_struct_array(batch.column(1).filter(pa.array(clean, pa.bool_())))

        whole = left.select(normalised("text").alias("plain"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
        left = whole.mapInArrow(tidy(run), docs.schema)
    return left
