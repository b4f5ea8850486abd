"""Fuzzy matches against all pairs: no first letter or word decides what is compared."""

import math
import random
from collections import Counter

import pytest

from tradelake.operators import edits, match


def test_a_typo_in_the_first_letter_is_resolved(spark):
    ref = spark.createDataFrame([("JPN", "Japan"), ("AUS", "Australia")], ["iso3", "name"])
    aliases = spark.createDataFrame([], "alias string, name string")
    names = spark.createDataFrame([("Xapan",), ("The Australia",), ("Zzzzz",)], ["name"])
    got = {r.name: (r.iso3, r.how) for r in match.resolve_country_by_name(names, ref, aliases, floor=65.0).collect()}
    assert got == {"Xapan": ("JPN", "fuzzy"), "The Australia": ("AUS", "fuzzy"), "Zzzzz": (None, "unresolved")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_sorted_words_are_compared_with_all_texts(spark):
    texts = ["frozen shrimps", "a frozen shrimps", "shrimps fresh", "coffee beans roasted", "black coffee beans roasted", "tea", "", "zebra hides", "b"]
    frame = [(f"{i}", t) for i, t in enumerate(texts)]
    queries = spark.createDataFrame(frame, ["query_id", "text"])
    for shift in (1, 2):
        corpus = [(f"{i}", texts[(i + shift) % len(texts)] + "x") for i in range(len(texts))]
        got = {r.query_id: (r.doc_id, r.score) for r in match.token_sort_match(queries, spark.createDataFrame(corpus, ["doc_id", "text"])).collect()}
        want = {}
        for q, a in frame:
            a = " ".join(sorted(a.split()))
            scored = []
            for d, b in corpus:
                b = " ".join(sorted(b.split()))
                scored.append((-round((1 - distance(a, b) / max(len(a), len(b), 1)) * 100, 6), d))
            best = min(scored)
            if -best[0] >= 60:
                want[q] = (best[1], -best[0])
        assert got == want


def test_an_extra_first_word_does_not_hide_a_match(spark):
    queries = spark.createDataFrame([("q", "a frozen shrimps")], ["query_id", "text"])
    corpus = spark.createDataFrame([("d", "shrimps frozen")], ["doc_id", "text"])
    assert [(r.query_id, r.doc_id) for r in match.token_sort_match(queries, corpus).collect()] == [("q", "d")]


def test_edit_join_finds_every_pair(spark):
    """Against all pairs, for floors with few and with many edits, texts of one letter to thirty."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 30))) for _ in range(25)] + ["a", "aa", "é漢字x", "ab" * 9]
    texts = set(base)
    for t in base:
        for _ in range(5):
            w = list(t)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d", "é"])
            texts.add("".join(w))
    left, right = sorted(texts)[::2], sorted(texts)[1::2] + base
    frame = lambda ts: spark.createDataFrame([(t,) for t in [*ts, None, ""]], "t string")
    for floor in (55.0, 70.0, 95.0, 100.0):
        got = {(r.a, r.b): r.score for r in edits.similarity_join(frame(left), frame(right), floor).collect()}
        want = {(a, b): s for a in set(left) - {""} for b in set(right) - {""} if (s := round((1 - distance(a, b) / max(len(a), len(b))) * 100, 6)) >= floor}
        assert got == want and want
    with pytest.raises(ValueError):
        edits.similarity_join(frame(left), frame(right), 50.0)


def test_variants_come_before_similar_names(spark):
    ref = spark.createDataFrame([("KOR", "Korea, Republic of"), ("PRK", "Korea, D.P.R."), ("GMB", "Gambia")], ["iso3", "name"])
    variants = spark.createDataFrame([("South Korea", "KOR"), ("Korea", "KOR"), ("korea", "PRK"), ("Nowhere", "XXX")], ["variant", "iso3"])
    names = spark.createDataFrame([("south-korea",), ("Korea",), ("The Gambia",), ("Gambja",), ("Nowhere",), (" ",), (None,)], ["name"])
    got = {r.name: (r.iso3, r.how) for r in match.resolve_country_by_name(names, ref, spark.createDataFrame([], "alias string, name string"), variants=variants).collect()}
    assert got == {"south-korea": ("KOR", "variant"), "Korea": (None, "unresolved"), "The Gambia": ("GMB", "variant"), "Gambja": ("GMB", "fuzzy"), "Nowhere": (None, "unresolved")}


def test_best_cosine_equals_the_full_product(spark):
    """Grams in every text, equal scores, words that the corpus lacks, empty texts."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    corpus = [(f"d{i:03d}", f"common {text(rng.randint(1, 8))}") for i in range(80)] + [("d900", "common"), ("d901", "common"), ("d902", "")]
    queries = [(f"q{i}", text(rng.randint(1, 6)) + rng.choice(["", " common", " unheard"])) for i in range(60)] + [("q90", "common"), ("q91", "unheard"), ("q92", None), ("q93", "common unheard words")]

    def grams(t):
        w = [x for x in (t or "").split() if x not in match.STOP_WORDS]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])

    df = Counter(g for _, t in corpus for g in grams(t))
    idf = {g: math.log((1 + len(corpus)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(t):
        v = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    units = {d: unit(t) for d, t in corpus}
    for floor in (0.05, 0.2, 0.9):
        want = {}
        for q, t in queries:
            v = unit(t)
            best = min(((-round(sum(x * u.get(g, 0) for g, x in v.items()), 9), d) for d, u in units.items()), default=None)
            if -best[0] >= floor:
                want[q] = (best[1], -best[0])
        got = {r.query_id: (r.doc_id, r.score) for r in match.tfidf_best_match(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(corpus, ["doc_id", "text"]), floor).collect()}
        assert {q: d for q, (d, _) in got.items()} == {q: d for q, (d, _) in want.items()} and want
        assert all(abs(got[q][1] - want[q][1]) < 2e-9 for q in want)
