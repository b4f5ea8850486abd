"""Ids of other types, columns whose names clash with inner ones, and empty tables, for every operator and stage."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tradelake.llm import decontaminate, embedding_dedup, language_id, line_dedup, near_copies, piece_codec, quality, simhash, suffix_dedup, token_count, warc

from .conftest import LINE, SHARED

CLASHING = ["gone", "doc", "id", "row", "bitmap", "doc_of_map", "key", "fp", "plain", "own", "rank_", "hashes", "component_id", "bits"]
ITEMS = [("q1", SHARED), ("q2", "one two"), (None, LINE)]


@pytest.fixture(scope="module")
def named(odd):
    """The odd rows with text ids in the order of the numbers, and clashing columns."""
    name = F.format_string("d%04d", "doc_id")
    return odd.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), name)).withColumns({c: F.lit(7) for c in CLASHING})


def as_text(v):
    return f"d{v:04d}" if isinstance(v, int) and not isinstance(v, bool) else v


def ids(df, *columns, text=False):
    rows = [tuple(as_text(r[c]) if text and c in ("doc_id", "component_id") else r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=str)


OPERATORS = {
    "simhash": (simhash.near_duplicates, ["doc_id", "fingerprint", "component_id"]),
    "keep_one": (simhash.keep_one, ["doc_id", "text"]),
    "near_copies": (near_copies.near_copies, ["doc_id", "component_id"]),
    "lines": (line_dedup.digest, ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
    "drop_lines": (line_dedup.drop_shared_lines, ["doc_id", "text", "n_chars"]),
    "suffixes": (suffix_dedup.remove_repeats, ["doc_id", "n_removed", "n_spans", "kept_sha256"]),
    "tokens": (lambda d: token_count.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), ["doc_id", "n_tokens"]),
    "pieces": (lambda d: piece_codec.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model"), verify=True), ["doc_id", "piece_ids", "decodes_back"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_text_ids_and_clashing_names(spark, odd, named, nothing, name):
    operator, columns = OPERATORS[name]
    assert ids(operator(named), *columns) == ids(operator(odd), *columns, text=True)
    empty = operator(nothing.withColumns({c: F.lit(7) for c in CLASHING}))
    assert empty.count() == 0


def test_leaks_with_text_ids(spark, odd, named, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string").withColumns({c: F.lit(7) for c in CLASHING})
    found = ids(decontaminate.find_leaks(named, bench), "doc_id", "item_id", "distance")
    assert found == ids(decontaminate.find_leaks(odd, bench), "doc_id", "item_id", "distance", text=True)
    assert ("d0013", "q2", 0) in found and (None, "q1", 0) in found and ("d0005", None, 0) in found
    clean = decontaminate.drop_leaks(named, bench)
    assert clean.schema == named.schema and {r.doc_id for r in clean.collect()} == {r.doc_id for r in named.collect()} - {f[0] for f in found}
    assert decontaminate.drop_leaks(named, bench.where("false")).count() == named.count()
    assert decontaminate.drop_leaks(nothing, bench).count() == decontaminate.find_leaks(nothing, bench.where("false")).count() == 0


def test_models_with_text_ids(spark, odd, named, nothing):
    trees = language_id.train(named.select("text", "lang"))
    assert ids(language_id.predict(named, trees), "doc_id", "lang_pred") == ids(language_id.predict(odd, trees), "doc_id", "lang_pred", text=True)
    labels = spark.createDataFrame([(f"d{i:04d}", i % 2, int(i % 3 == 0)) for i in range(1, 14)], "doc_id string, quality int, toxic int")
    kept = quality.keep_good(named, labels)
    assert kept.schema == named.schema and quality.classify(named, labels).count() == named.count()
    empty = nothing.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert quality.keep_good(empty, labels).count() == 0 and quality.keep_good(named, labels.where("false")).count() == named.count()


def test_vectors_and_pages_with_text_ids(spark):
    rows = [("v1", [1.0, 0.0]), ("v2", [0.99, 0.01]), ("v2", [0.99, 0.01]), (None, [1.0, 0.0]), ("v9", [-1.0, 0.0]), ("v0", None), (None, [0.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>").withColumns({c: F.lit(7) for c in CLASHING})
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(vectors).collect())
    assert got == [("None", 0, "None", True), ("None", 3, "v1", True), ("v0", 0, "v0", True), ("v1", 3, "v1", True), ("v2", 3, "v1", False), ("v2", 3, "v1", False), ("v9", 0, "v9", True)]
    pages = spark.createDataFrame([("a b\n", "u", "x" * 1500), ("c", "w", "x" * 1500), (None, None, None)], "page_id string, url string, html string").withColumns({c: F.lit(7) for c in CLASHING})
    back = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert back == [("None", "response", "None", 0), ("a b\n", "revisit", "c", 1500), ("c", "response", "None", 1500)]


def test_stages_over_empty_tables(spark, nothing, tmp_path):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_views_hand_over_is_what_a_plain_sum_gives(spark):
    """The gradient and curvature of confident documents, against dense sums over all of them."""
    rnd = np.random.default_rng(4)
    rows = [(i, " ".join(rnd.choice(["good", "plain", "house", "river"], 6)) + (" BAD!!" if i % 4 == 0 else ""), f"s{i % 4}", "en", 30) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    features = quality.materialise(quality._prepared(docs, ["doc_id"], labels), "test-features")
    own = sorted(features.where("quality is not null").collect(), key=lambda r: r.row.doc_id)
    take = lambda rs, c: quality.Rows.of([np.array(r[c], np.int32) for r in rs])
    target = quality.CoTraining(take(own, "text"), take(own, "meta"), np.array([float(r.quality == 0) for r in own]))
    got = quality.handed_over(features, [target.models])[0]
    pool = features.where("quality is null").collect()
    for view, other in (("text", "meta"), ("meta", "text")):
        model, chance = target.models[view], quality._sigmoid(target.models[other].logit(take(pool, other)))
        x = np.column_stack([quality.dense(take(pool, view), model.chosen, quality._SIZES[view]), np.ones(len(pool))])
        w = np.append(model.weights[model.chosen], model.bias)
        p = quality._sigmoid(x @ w)
        for c in (0, 1):
            sure = chance >= quality.CONFIDENT if c else chance <= 1 - quality.CONFIDENT
            h = got[view][c]
            assert h.n == sure.sum()
            assert h.gradient == pytest.approx(x[sure].T @ (p[sure] - c), abs=1e-3)
            assert h.curvature == pytest.approx((x[sure] * (p * (1 - p))[sure][:, None]).T @ x[sure], abs=1e-3)
    assert sum(h.n for v in got.values() for h in v) > 0
