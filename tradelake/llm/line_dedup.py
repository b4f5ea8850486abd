"""Line dedup: lines that many documents share stay only in the document with the largest id."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, partitions, tidy, with_long_id

#: Least length of a key in code points, and the number of documents from which on it is a shared line.
MIN_CHARS, MIN_DOCS = 40, 5
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = {c: c + 32 for c in range(65, 91)}
_ROW = "h1 long, h2 long, doc long, version long, pos int"


def line_key(line: str) -> str:
    """The line without blanks (space, \\x09-\\x0D) at its ends and with A-Z in lower case."""
    return line.strip(_BLANK).translate(_UPPER)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for every line of docs (doc long, text) with a key of at least min_chars: 128-bit key hash, doc, version (hash
    of the whole text, which tells rows of one id apart) and line number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs_, versions, where = [], [], [], []
            for doc, text, version in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) < min_chars:
                    continue
                for i, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(_BLANK)) >= min_chars:
                        raw = key.encode()
                        keys.append(xxhash.xxh3_128_digest(raw.lower()))  # bytes: A-Z only
                        docs_.append(doc)
                        versions.append(version)
                        where.append(i)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs_, pa.int64()), pa.array(versions, pa.int64()), pa.array(where, pa.int32())], ["h1", "h2", "doc", "version", "pos"])

    return docs.where("text is not null").select("doc", "text", F.xxhash64("text")).mapInArrow(tidy(run), _ROW)


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))[0]


def _stream(batches: Iterator[pa.RecordBatch], window: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """The sorted rows of a partition in pieces of about window rows: (h1, h2, doc, version, pos)."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
        size += len(batch)
        if size >= window:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version, pos) of the lines to drop: those of keys in at least min_docs documents, but for the largest.

    lines is range-partitioned by (key hash, document, largest first) and sorted within partitions by these and by
    position, so that the first document of a key comes first and is the one that stays. The rows stream by once. A key
    that ends where it began is decided there; a key in very many documents may span partitions, so the rows of a
    partition's first key, and of its last one while that has too few documents, are put off: they are decided by the sum
    over partitions of what each has of its first and its last key (no more than two rows a partition, so it is
    broadcast). Rows of one key and document never lie in two partitions.
    """
    order = [F.col("h1").asc(), F.col("h2").asc(), F.col("doc").desc()]
    placed = lines.repartitionByRange(partitions(lines.sparkSession), *order).sortWithinPartitions(*order, "version", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, top, last_doc = None, True, 0, None, None
        waiting: list[tuple] = []  # rows of a key whose documents are still fewer than min_docs

        def edge() -> Iterator[pa.RecordBatch]:
            yield _rows(EDGE, *(np.array([x], np.int64) for x in (*key, n, top, 0)))

        for h1, h2, doc, version, pos in _stream(batches):
            out, off = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
            starts = _runs(h1, h2)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h1)], strict=True):
                now = (int(h1[s]), int(h2[s]))
                if now != key:
                    if key is not None and first:
                        yield from edge()
                    first, waiting, last_doc, n, top = key is None, [], None, 0, int(doc[s])
                    key = now
                own = doc[s:e]
                n += int((own[1:] != own[:-1]).sum()) + (last_doc != int(own[0]))
                last_doc = int(own[-1])
                if first:
                    off[s:e] = True
                elif n >= min_docs:
                    if waiting:
                        early = tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                        which = early[2] != top
                        yield _rows(DROP, *(x[which] for x in early))
                        waiting = []
                    out[s:e] = own != top
                elif e == len(h1):
                    waiting.append(tuple(x[s:e].copy() for x in (h1, h2, doc, version, pos)))
            yield _rows(DROP, *(x[out] for x in (h1, h2, doc, version, pos)))
            yield _rows(LATER, *(x[off] for x in (h1, h2, doc, version, pos)))
        if waiting:
            yield _rows(LATER, *(np.concatenate(x) for x in zip(*waiting, strict=True)))
        if key is not None:
            yield from edge()

    found = materialise(placed.mapInArrow(tidy(run), f"what int, {_ROW}"), "lines-found")
    edges = found.where(F.col("what") == EDGE).groupBy("h1", "h2").agg(F.sum("doc").alias("docs"), F.max("version").alias("top"))
    later = found.where(F.col("what") == LATER).join(F.broadcast(edges.where(F.col("docs") >= min_docs)), ["h1", "h2"]).where("doc <> top")
    return found.where(F.col("what") == DROP).select("doc", "version", "pos").unionByName(later.select("doc", "version", "pos"))


#: Kinds of rows that a partition tells: a line to drop, a line to decide later, and (documents, largest) of an edge key.
DROP, LATER, EDGE = 0, 1, 2


def _rows(what: int, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, version: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), what, np.int32)), *[pa.array(x) for x in (h1, h2, doc, version)], pa.array(pos.astype(np.int32))], ["what", "h1", "h2", "doc", "version", "pos"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version, bitmap) of the documents of docs (doc long, text) that lose lines: a compressed bitmap with a bit for
    each line up to the last that is dropped, set where the line is kept; all later lines are kept. Documents that keep all
    their lines have no row; texts are not returned. version is the hash of the text."""
    lines = materialise(hashed_lines(docs, min_chars), "lines")
    lists = dropped_lines(lines, min_docs).groupBy("doc", "version").agg(F.collect_list("pos").alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for at in batch.column(2).to_pylist():
                bits = np.ones((max(at) + 8) // 8 * 8, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc", "version", "bitmap"])

    return lists.mapInArrow(tidy(pack), "doc long, version long, bitmap binary")


def dropped_positions(bitmap: bytes | None) -> list[int]:
    return np.nonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)) == 0)[0].tolist() if bitmap else []


def _with_bitmaps(docs: DataFrame, columns: list[str], min_chars: int, min_docs: int) -> DataFrame:
    """The columns of docs and, last, the bitmap of each row (null: keeps all lines)."""
    own = fresh(docs, "doc")
    keyed = with_long_id(docs, own)
    maps = keep_bitmaps(keyed.select(F.col(own).alias("doc"), "text"), min_chars, min_docs)
    names = [fresh(keyed, n) for n in ("doc_of_map", "version_of_map", "bitmap")]
    maps = maps.toDF(*names)
    joined = keyed.join(maps.hint("merge"), (F.col(own) == F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], names[2])


def _kept(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    gone = set(dropped_positions(bitmap))
    return ("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text), len(lines), len(gone)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs (doc_id of any type, text) once the shared lines are gone.

    A null or empty text is one empty line. A null id counts as smaller than any; rows that share an id are one document
    where documents are counted, and each loses its own lines. Repeated rows give repeated results; whole texts are looked
    at, however long; other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t or "", b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = _with_bitmaps(docs.select("doc_id", "text"), ["doc_id", "text"], min_chars, min_docs)
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the shared lines taken out of text (null stays null); every other column and row as before, whatever its
    name, but n_chars, where there is one, is the length of the new text. Odd rows fare as in digest()."""
    names = docs.columns
    marked = _with_bitmaps(docs, names, min_chars, min_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            maps = batch.column(len(names)).to_pylist()
            if any(maps):
                texts = columns["text"].to_pylist()
                columns["text"] = pa.array([_kept(t, b)[0] if b else t for t, b in zip(texts, maps, strict=True)], columns["text"].type)
                if "n_chars" in columns:
                    old = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(t) if b else n for t, b, n in zip(columns["text"].to_pylist(), maps, old, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return marked.mapInArrow(tidy(run), docs.schema)
