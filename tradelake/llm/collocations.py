"""Phrase collocation mining: best-first branch-and-bound growth of phrases by their next word.

A phrase that begins with a word of f occurrences scores 1000 n / f at most, however it goes on: the cut after the first word
has l = f, and its right part occurs at least as often as the whole. Phrases wait in a frontier by the better of their own score
and this bound. A round takes the best of them, counts in one pass over the texts which words stand behind and before each, and
puts the longer phrases into the frontier. A language is settled when nothing in its frontier can reach its last reported score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, utf8_slices

#: The bytes that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: No byte of UTF-8: stands for the end of a piece while texts are split.
_END = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\x09", bytes(range(97, 123)) + _END * len(PIECE_ENDS) + b"\x20")
#: Phrases that a round takes from the frontier (their suffixes come with them); words that a task numbers, counts that it
#: gathers and bytes of text that it splits at once; bits that tell frequent words from others. These change the cost and no result.
BATCH, WORDS, GATHERED, STEP, BITS, SEED = 200_000, 1_000_000, 2_000_000, 2 << 20, 1 << 25, 42


class Numbering(dict):
    """Numbers words as they come; words holds them by number."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def numbered(text: bytes, numbers: Numbering) -> np.ndarray:
    """The numbers of a text's words, with numbers[_END] after every piece."""
    low, out, at = text.translate(_TABLE), [], 0
    while at < len(low):
        to = at + STEP
        if to < len(low):
            ends = [p for p in (low.find(b" ", to), low.find(_END, to)) if p >= 0]
            to = min(ends, default=len(low))
        words = low[at:to].replace(_END, b" \xff ").split()
        out.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        at = to
    return np.concatenate([*out, [numbers[_END]]]) if out else np.zeros(0, np.int64)


def by_language(batch: pa.RecordBatch, numbers: Numbering) -> Iterator[tuple[str, np.ndarray]]:
    """(language, numbers of its texts' words) for rows (lang, text), some megabytes of text at a time."""
    raw, ends = utf8_slices(batch.column(1))
    langs = batch.column(0).to_pylist()
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, own in rows.items():
        parts, size = [], 0
        for i in own:
            parts.append(numbered(raw[ends[i] : ends[i + 1]].tobytes(), numbers))
            size += int(ends[i + 1] - ends[i])
            if size >= STEP:
                yield lang, np.concatenate(parts)
                parts, size = [], 0
        if parts:
            yield lang, np.concatenate(parts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word, and with a null word how many there are; a row for each task and word, not added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = Numbering(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            end = numbers.get(_END, -1)
            for lang, c in counts.items():
                own = np.nonzero(c)[0]
                own = own[own != end]
                words = [numbers.words[i] for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(own) + 1), pa.string()), pa.array([*words, None], pa.string()), pa.array(np.append(c[own], c[own].sum()))], ["lang", "word", "f"])
            counts.clear()
            numbers.clear()
            numbers.words.clear()

        for batch in batches:
            for lang, codes in by_language(batch, numbers):
                c = np.bincount(codes, minlength=len(numbers.words))
                old = counts.get(lang, np.zeros(0, np.int64))
                c[: len(old)] += old
                counts[lang] = c
            if len(numbers) > WORDS:
                yield from flush()
        yield from flush()

    return _texts(docs).mapInArrow(run, "lang string, word string, f long")


class Trie:
    """The phrases of one language that a round grows: from a node and a word's number to the next node."""

    def __init__(self, phrases: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        step: list[dict[int, int]] = [{} for _ in range(max(len(w) for _, w in phrases))]
        nodes, self.pid = 1, {}
        width = 1 + len({w for _, words in phrases for w in words})
        for pid, words in phrases:
            node = 0
            for depth, w in enumerate(words):
                key = node * width + self.number.setdefault(w, len(self.number))
                node = step[depth].setdefault(key, nodes)
                nodes += node == nodes
            self.pid[node] = pid
        self.width = width
        self.keys = [np.array(sorted(s), np.int64) for s in step]
        self.nodes = [np.array([s[k] for k in keys.tolist()], np.int64) for s, keys in zip(step, self.keys, strict=True)]
        pid = np.full(nodes, -1, np.int64)
        pid[list(self.pid)] = list(self.pid.values())
        self.pid = pid

    def found(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, phrase numbers) of all phrases in words (own numbers, -1 for other words and ends)."""
        at = np.nonzero(words >= 0)[0]
        node = np.zeros(len(at), np.int64)
        for depth, (keys, nodes) in enumerate(zip(self.keys, self.nodes, strict=True)):
            inside = at + depth < len(words)
            at, node = at[inside], node[inside]
            w = words[at + depth]
            key = node * self.width + w
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (w >= 0) & (keys[i] == key)
            at, node = at[hit], nodes[i[hit]]
            pid = self.pid[node]
            own = pid >= 0
            yield depth + 1, at[own], pid[own]


def neighbours(docs: DataFrame, phrases: list[tuple[int, str, str]], frequent: bytes) -> DataFrame:
    """(pid, before, word, f): how often each word that may be frequent stands behind each of the phrases (pid, lang, phrase), and
    before those of several words; a row for each task, not added up. frequent: bit xxh64(word) mod BITS of every word
    that matters."""
    shared = docs.sparkSession.sparkContext.broadcast((phrases, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = shared.value
        by_lang: dict[str, list[tuple[int, list[bytes]]]] = {}
        for pid, lang, phrase in own:
            by_lang.setdefault(lang, []).append((pid, phrase.encode().split(b" ")))
        tries = {lang: Trie(p) for lang, p in by_lang.items()}
        bits = np.frombuffer(bits, np.uint8)
        numbers, waiting, size = Numbering(), [], 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        local = {lang: np.zeros(0, np.int64) for lang in tries}
        counted = np.zeros(0, bool)

        def gather() -> None:
            nonlocal keys, counts, size
            new, n = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]), return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            waiting.clear()
            size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts, counted
            gather()
            for a, b in pairwise([*range(0, len(keys), 100_000), len(keys)]):
                k = keys[a:b]
                words = pa.array([numbers.words[i] for i in (k & 0x7FFFFFFF).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k >> 31 & 1).astype(bool)), words, pa.array(counts[a:b])], ["pid", "before", "word", "f"])
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(numbers) > WORDS:
                numbers.clear()
                numbers.words.clear()
                counted = np.zeros(0, bool)
                local.update({lang: np.zeros(0, np.int64) for lang in local})

        for batch in batches:
            for lang, codes in by_language(batch, numbers):
                if lang not in tries:
                    continue
                trie, end = tries[lang], numbers[_END]
                fresh = numbers.words[len(counted) :]
                hashed = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in fresh), np.uint64, len(fresh)) % np.uint64(BITS)
                counted = np.concatenate([counted, (bits[hashed >> np.uint64(3)] >> (hashed & np.uint64(7)).astype(np.uint8) & 1).astype(bool)])
                fresh = numbers.words[len(local[lang]) :]
                local[lang] = np.concatenate([local[lang], np.fromiter((trie.number.get(w, -1) for w in fresh), np.int64, len(fresh))])
                padded = np.concatenate([[end], codes, [end]])
                counts_here = counted.copy()
                counts_here[end] = False
                mine = local[lang].copy()
                mine[end] = -1
                for length, at, pid in trie.found(mine[codes]):
                    behind = padded[at + 1 + length]
                    use = counts_here[behind]
                    waiting.append(pid[use] << 32 | behind[use])
                    size += int(use.sum())
                    if length > 1:
                        ahead = padded[at]
                        use = counts_here[ahead]
                        waiting.append(pid[use] << 32 | 1 << 31 | ahead[use])
                        size += int(use.sum())
                if size > GATHERED:
                    gather()
            if len(keys) > GATHERED or len(numbers) > WORDS:
                yield from flush()
        yield from flush()

    return _texts(docs).mapInArrow(run, "pid int, before boolean, word string, f long")


def frequent_bits(words: DataFrame) -> bytes:
    """A bitmap of BITS bits, whatever the number of words (column phrase)."""
    bit = F.pmod(F.xxhash64("phrase"), F.lit(BITS))
    # the hash is signed in SQL; BITS divides 2 ** 64, so both remainders agree
    parts = words.select(F.bitmap_bucket_number(bit + 1).alias("bucket"), F.bitmap_bit_position(bit + 1).alias("place"))
    rows = parts.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect()  # one for each 32768 bits
    out = bytearray(BITS // 8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(out)


def lowest_cut(found: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """found (lang, phrase, m, f, pre) with cut (score, k, l, r): that of the lowest score, ties to the smallest k. pre[k - 1] is the
    number of the first k words; known (lang, phrase, f) has every rest. Products are decimals of 38 digits."""
    rest = found.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.expr("slice(pre, 1, m - 1)")).alias("k", "l"), "m")
    rest = rest.withColumn("rest", F.expr("concat_ws(' ', slice(split(phrase, ' '), k + 2, m))"))
    other = known.select(F.col("lang").alias("lang_"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = rest.join(other, (F.col("lang") == F.col("lang_")) & (rest["rest"] == other["rest"])).drop("lang_", "rest").join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(cast(1000 as decimal(4,0)) * cast(cast(a as decimal(17,0)) as decimal(17,0)) * cast(n as decimal(17,0)) div ({big('l')} * {big('r')}) as long)")
    least = met.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), (F.col("k") + 1).alias("k"), "l", "r")).alias("cut"))
    return found.join(least, ["lang", "phrase"])


def mine(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, percent: int = 100, batch: int = BATCH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language of docs (text, lang; null lang: "und") the first `top` phrases
    by score, then by a, then by the phrase's bytes.

    Texts are lower-cased (A-Z), split at PIECE_ENDS into pieces and these at BLANKS into words. A phrase of 2 to longest words
    that occurs a >= least times is a candidate; of its cuts into l and r occurrences the one with the lowest
    1000 a n / (l r), rounded down, gives its score (ties: the shortest first part), n being the language's words. A candidate
    within a longer one that has at least percent percent of its occurrences is dropped.

    Null and empty texts have no words, repeated rows count each time, other columns are ignored, whatever their names, and an
    empty table gives an empty result. Texts are read whole and stay where they are; a round sends `batch` phrases and
    their suffixes out and shuffles counts of word pairs only. The frontier is a stored table.
    """
    counted = materialise(word_counts(docs).groupBy("lang", "word").agg(F.sum("f").alias("f")).where(f"word is null or f >= {least}"), "phrases-words")
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    first = counted.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), "f", F.array("f").alias("pre"))
    nothing = F.lit(None)
    cut_type = "struct<score:bigint,k:int,l:bigint,r:bigint>"
    state = materialise(first.select("*", nothing.cast(cut_type).alias("cut"), nothing.cast("long").alias("grown")), "phrases-state")
    frequent = frequent_bits(state)
    by_score = Window.partitionBy("lang").orderBy(F.desc("cut.score"))
    survives = f"m > 1 and (m = {longest} or 100 * grown < {percent} * f)"
    while True:
        last = state.where(survives).withColumn("rank_", F.row_number().over(by_score)).where(F.col("rank_") == top).select("lang", F.col("cut.score").alias("bar"))
        waiting = state.where(f"m < {longest} and grown is null").join(totals, "lang").join(last, "lang", "left")
        bound = F.expr("cast(cast(1000 as decimal(4,0)) * cast(n as decimal(19,0)) div cast(pre[0] as decimal(19,0)) as long)")
        reach = waiting.withColumn("reach", F.greatest(F.coalesce("cut.score", F.lit(0)), bound)).where("bar is null or reach >= bar")
        best = reach.orderBy(F.desc("reach"), "lang", "phrase").limit(batch).select("lang", "phrase")
        parts = F.expr("transform(sequence(0, size(split(phrase, ' ')) - 1), i -> concat_ws(' ', slice(split(phrase, ' '), i + 1, 100)))")
        with_suffixes = best.select("lang", F.explode(parts).alias("phrase")).distinct()
        taken = state.where("grown is null").join(with_suffixes, ["lang", "phrase"]).select("lang", "phrase", "m", "f", "pre")
        chosen = taken.select("lang", "phrase").toArrow().to_pylist()  # longest - 1 times batch at most
        if not chosen:
            break
        chosen = [(i, r["lang"], r["phrase"]) for i, r in enumerate(sorted(chosen, key=lambda r: (r["lang"], r["phrase"])))]
        counts = neighbours(docs, chosen, frequent).groupBy("pid", "before", "word").agg(F.sum("f").alias("a")).where(f"a >= {least}")
        names = docs.sparkSession.createDataFrame(pa.table(dict(zip(("pid", "lang", "phrase"), (pa.array(c, t) for c, t in zip(zip(*chosen, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)), strict=True))))
        around = materialise(counts.join(names, "pid").select("lang", "phrase", "before", "word", "a"), "phrases-around")
        longer = around.where("not before").join(state.select("lang", "phrase", "m", "pre"), ["lang", "phrase"])
        found = materialise(longer.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), (F.col("m") + 1).alias("m"), F.col("a").alias("f"), F.concat("pre", F.array("a")).alias("pre")), "phrases-found")
        known = state.select("lang", "phrase", "f").unionByName(found.select("lang", "phrase", "f"))
        scored = lowest_cut(found, known, totals).select("lang", "phrase", "m", "f", "pre", F.col("cut").cast(cut_type).alias("cut"), nothing.cast("long").alias("grown"))
        most = names.select("lang", "phrase").join(around.groupBy("lang", "phrase").agg(F.max("a").alias("most")), ["lang", "phrase"], "left").select("lang", "phrase", F.coalesce("most", F.lit(0)).alias("most"))
        grown = state.join(most, ["lang", "phrase"], "left").select("lang", "phrase", "m", "f", "pre", "cut", F.coalesce("grown", "most").alias("grown"))
        before, state = state, materialise(grown.unionByName(scored), "phrases-state")
        discard(before, around, found)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    ranked = state.where(survives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def oracle(top: int = 2000, least: int = 100, longest: int = 5, percent: int = 100) -> str:
    """DuckDB SQL for the rows of mine() over the table documents."""
    return rf"""
        with pieces as (
            select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
            from documents),
        w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
        f as materialized (
            select lang, w[i:i + m - 1] p, m, count(*) f from w, range(1, {longest + 1}) s(m), lateral (select unnest(range(1, len(w) - m + 2)) i) group by all having count(*) >= {least}),
        totals as (select lang, sum(len(w)) n from w group by lang),
        cuts as (
            select c.lang, c.p, c.m, c.f a, k, x.f l, y.f r, n, (1000::hugeint * c.f * n) // (x.f::hugeint * y.f) score
            from f c join totals using (lang), lateral (select unnest(range(1, c.m)) k)
            join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:]
            where c.m > 1),
        lowest as (select lang, p, m, a, n, min({{'score': score, 'k': k, 'l': l, 'r': r}}) c from cuts group by all),
        inner_ as (
            select distinct s.lang, s.p from f b, lateral (select unnest(range(2, b.m)) m) t, lateral (select unnest(range(1, b.m - t.m + 2)) i) u
            join f s on s.lang = b.lang and s.p = b.p[i:i + t.m - 1] where 100 * b.f >= {percent} * s.f),
        ranked as (
            select lang, row_number() over (partition by lang order by c.score desc, a desc, array_to_string(p, ' ')) rank, array_to_string(p, ' ') phrase, a, c.l l, c.r r, n, c.score score
            from lowest anti join inner_ using (lang, p))
        select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked where rank <= {top}"""
