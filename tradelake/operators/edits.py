"""Edit-distance join by segments: an inverted index of pieces, looked up at the shifts that the budget allows.

Two texts of lengths n and m with at most t edits between them: one of t + 1 pieces of the second stands unchanged in the first, and
for some such piece number i its shift d obeys |d| <= i and |n - m - d| <= t - i, as there is an edit in every piece before it and
after it. So both sides become rows keyed by (m, t, i, piece), and an equi-join finds every pair; the distance itself is
computed for those pairs only, and given up beyond the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores are rounded to six places, so a little more than the budget may pass.
SLACK = 1e-6


def similarity_join(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, score) for every pair of a distinct text a of left and b of right whose score, 100 * (1 - edits / longer
    length) rounded to six places, is floor or more. floor must be over 50: below, no piece need be left.

    Null and empty texts match nothing. Each text has as many rows as it has pieces, for each length that it can be matched
    with, whatever the other texts are."""
    if not 50 < floor <= 100:
        raise ValueError("the floor must be over 50 and not over 100")
    share = (100.0 - floor + SLACK) / 100.0
    budget = f"int(floor({share!r} * {{0}}))"
    a = left.select(F.col(left.columns[0]).alias("a")).where("a <> ''").distinct().selectExpr("a", "length(a) as n")
    b = right.select(F.col(right.columns[0]).alias("b")).where("b <> ''").distinct().selectExpr("b", "length(b) as m")
    # the longest partner has m / (1 - share) letters
    widest = budget.format(f"floor(m / {1 - share!r})")
    pieces = (
        b.selectExpr("b", "m", f"explode(sequence({budget.format('m')}, least({widest}, m - 1))) as t")
        .selectExpr("b", "m", "t", "explode(sequence(0, t)) as i")
        .selectExpr("b", "m", "t", "i", "substring(b, 1 + i * m div (t + 1), (i + 1) * m div (t + 1) - i * m div (t + 1)) as piece")
    )
    looked = (
        a.selectExpr("a", "n", f"explode(sequence(int(ceil(n * {1 - share!r})), int(floor(n / {1 - share!r})))) as m")
        .selectExpr("a", "n", "m", f"{budget.format('greatest(n, m)')} as t")
        .where("m > t")
        .selectExpr("a", "n", "m", "t", "explode(sequence(0, t)) as i")
        .selectExpr("a", "n", "m", "t", "i", "greatest(-i, n - m - (t - i)) as low", "least(i, n - m + (t - i)) as high", "int(i * m div (t + 1)) as p", "int((i + 1) * m div (t + 1) - i * m div (t + 1)) as l")
        .where("low <= high")
        .selectExpr("a", "n", "m", "t", "i", "p", "l", "explode(sequence(low, high)) as d")
        .where("p + d >= 0 and p + d + l <= n")
        .selectExpr("a", "m", "t", "i", "substring(a, 1 + p + d, l) as piece")
        .distinct()
    )
    met = looked.join(pieces, ["m", "t", "i", "piece"]).selectExpr("a", "b", "t").where("abs(length(a) - length(b)) <= t and levenshtein(a, b) <= t")
    score = F.expr("round((1 - levenshtein(a, b) / cast(greatest(length(a), length(b)) as double)) * 100, 6)")
    return met.select("a", "b").distinct().withColumn("score", score).where(F.col("score") >= floor)
