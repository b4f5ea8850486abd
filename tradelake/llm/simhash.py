"""SimHash near-dedup: fingerprints, a grid range join of their segment popcounts, exact verification, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, each_text, fresh, join_by_key, materialise, partitions, tidy

#: Shingle length in words, hash seed, differing bits of a link.
SHINGLE_WORDS, SEED, BITS = 3, 42, 2
#: Blocks of segments beyond BITS that a grid cell keeps (so BITS + KEPT are cut), and the fingerprints of a cell that are
#: paired with one another at most; fuller cells are joined by exact values. Both change the cost and no result.
KEPT, CROWD = 4, 32
_SEGMENTS = 32


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[s : s + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    return sum(1 << i for i in np.nonzero(2 * bit_sums(hashes) > len(hashes))[0].tolist())


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles; zero without words."""
    words = text.lower().split()  # bytes: lower-cases A-Z and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(min(width, len(words)))), strict=False)
    return majority(np.fromiter((digest(join(t), SEED) for t in shingles), np.uint64))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row of docs (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in each_text(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def popcounts(fp: str) -> str:
    """SQL for the segment embedding of a fingerprint: the number of set bits of each of its 32 segments of 2 bits, each
    as two bits 00, 01 or 11. The Manhattan distance of two points is then the number of bits in which these differ."""
    odd = "6148914691236517205L"  # every other bit
    return f"((({fp} | shiftrightunsigned({fp}, 1)) & {odd}) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {odd}, 1))"


def _masks(bits: int, kept: int = KEPT) -> list[int]:
    """Masks over the embedding, as signed longs: all choices of kept of bits + kept blocks of segments."""
    cuts = [round(i * _SEGMENTS / (bits + kept)) for i in range(bits + kept + 1)]
    blocks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    chosen = [sum(c) for c in combinations(blocks, kept)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _flips(column: str) -> str:
    """SQL: a value and every value that differs from it in one of 64 bits."""
    return f"concat(array({column}), transform(sequence(0, 63), i -> {column} ^ shiftleft(1L, i)))"


def candidate_pairs(distinct: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded) of distinct fingerprints (column fp): pairs (a, b, distance) whose popcount points lie within a
    Manhattan distance of bits, which no pair within so many differing bits fails, and the fingerprints (fp) of crowded
    cells, among which no pairs were listed.

    Grid range join: the 32 dimensions are cut into bits + KEPT blocks. Points at a distance of at most bits agree in KEPT
    blocks, so every point enters one cell of each grid that is made by keeping KEPT of the blocks.
    """
    spark = distinct.sparkSession
    grid = distinct.select("fp", F.expr(popcounts("fp")).alias("p"))
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.expr(f"p & {m}L" if m > -(2**63) else "p & (-9223372036854775807L - 1)").alias("cell")) for i, m in enumerate(_masks(bits))]))
    cells = grid.select("fp", "p", entries.alias("c")).select("fp", "p", "c.grid", "c.cell")
    counts = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(cells.join(counts.hint("merge"), ["grid", "cell"]), "simhash-cells")
    few = shared.where(F.col("n") <= CROWD).select("grid", "cell", "fp", "p").repartition(partitions(spark), "grid", "cell")
    x, y = few.alias("x"), few.alias("y")
    met = x.join(y.hint("merge"), F.expr("x.grid = y.grid and x.cell = y.cell and x.fp < y.fp"))
    near = met.where(f"bit_count(x.p ^ y.p) <= {bits}").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    return near.withColumn("distance", F.expr("bit_count(a ^ b)")), shared.where(F.col("n") > CROWD).select("fp").distinct()


def near_edges(distinct: DataFrame) -> DataFrame:
    """(a, b) long: links among distinct fingerprints (column fp) whose transitive closure is that of all pairs at BITS (2)
    or fewer differing bits.

    Those are the candidate pairs that the exact distance confirms. In crowded cells, where all pairs would be too many,
    fingerprints are within 2 bits just if some 64-bit value is within one bit of both; all that meet at such a value
    are within 2 bits of one another, so each is linked to the smallest of them. That grouping combines before the
    shuffle, so that a crowded value is no heavy task.
    """
    pairs, crowded = candidate_pairs(distinct, BITS)
    middles = crowded.repartition(partitions(distinct.sparkSession), "fp").select("fp", F.explode(F.expr(_flips("fp"))).alias("middle"))
    meet = middles.groupBy("middle").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    starred = middles.join(meet.select("middle", "low").hint("merge"), "middle").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.where(F.col("distance") <= BITS).select("a", "b").unionByName(starred)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of docs (doc_id of any type, text).

    Documents whose fingerprints differ in 2 or fewer bits are linked; component_id is the smallest doc_id that
    links reach (null ids do not count; null if there is no other). A null or word-less text has fingerprint zero and
    is linked like any other. Equal fingerprints are one node, so copies are never paired with one another. Repeated
    rows give repeated results. Whole texts count, however long. Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    marked = materialise(fingerprints(docs), "simhash-fingerprints")
    counted = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = materialise(counted.repartition(partitions(spark), "fp"), "simhash-classes")
    edges = materialise(near_edges(classes.select("fp")), "simhash-edges")
    by_class = component_ids(classes, "fp", edges)
    out = join_by_key(marked, by_class, "fp", F.col("n"), marked.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(classes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, n, component_id) for classes (node, first, n) under edges (a, b) between nodes: the smallest first that the
    edges reach."""
    roots = connected_components(edges)
    labelled = materialise(classes.join(roots.withColumnRenamed("node", node).hint("merge"), node, "left").select(node, "first", "n", F.coalesce("root", node).alias("root")), "labelled")
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    named = join_by_key(labelled, lowest, "root", F.col("size"), labelled.count())
    out = materialise(named.select(node, "n", "component_id"), "components")
    discard(labelled, edges)
    return out


def keep_one(docs: DataFrame, linked: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs without those that have a near duplicate with a smaller doc_id in their component (of linked); same columns,
    whatever their names, and rows with ids of any type.

    A document is its doc_id: rows that share one stay or go together. Rows with a null id cannot be told apart, so they all
    stay. Empty tables and null or empty texts are treated as linked() does.
    """
    gone = fresh(docs, "gone")
    groups = linked(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).where("component_id is not null and doc_id is not null")
    dropped = groups.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped.hint("merge"), docs["doc_id"].eqNullSafe(dropped[gone]), "left_anti")
