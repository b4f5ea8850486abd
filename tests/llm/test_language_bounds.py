"""Language identification: the query's split, ties, and the share of a large language that is learned from."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from tradelake.llm import language_id, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_query_learns_from_three_quarters_only(spark):
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op2_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r[0]} == set(held) and len(got) == docs.count()
    # what the held-out rows say of their language changes nothing
    misled = docs.withColumn("lang", F.when(F.col("doc_id").isin(held), "xx").otherwise(F.col("lang")))
    trees = language_id.train(misled.where(~F.col("doc_id").isin(held)).select("text", "lang"))
    assert {r.doc_id: (got[r.doc_id][0], r.lang_pred, r.score) for r in language_id.predict(docs, trees).collect()} == got


def test_of_equal_codes_the_first_name_counts(spark):
    texts = [("one text for both", lang) for lang in ("zz", "aa", "mm")] + [("quite another thing 12345", "bb")]
    trees = language_id.train(spark.createDataFrame(texts, "text string, lang string"))
    docs = spark.createDataFrame([(1, "one text for both"), (2, "one text"), (3, None), (4, "123")], "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.predict(docs, trees).collect()}
    assert got[1] == ("aa", round(1 / 3, 6)) and got[2][0] == "aa" and got[3] == got[4] == ("und", 0.0)


def test_a_large_language_is_learned_from_in_part(spark):
    docs = spark.range(4000).select(F.concat(F.lit("text number "), F.lpad(F.col("id").cast("string"), 8, "0")).alias("text"), F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("lang"))
    part = {r.lang: r.n for r in language_id.share_of(docs, 20_000).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert part["small"] == 40 * 20 and 15_000 < part["large"] < 25_000
    again = language_id.share_of(docs, 20_000)
    assert sorted(again.collect()) == sorted(again.collect())
    full, few = (language_id.train(docs, most)[0] for most in (10**9, 5_000))
    assert len(few.bits) < len(full.bits)
