"""The pipeline's stages on the smallest tables."""

import os
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tradelake.llm import decontaminate
from tradelake.llm.queries import QUERIES

from .test_near_copies import plain_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "pieces"]
    counts = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        if name != "pieces":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        counts.append(now.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0.5 * counts[0]
    assert now.where("not decodes_back").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r.doc_id for r in now.collect())


def test_run_is_what_plain_steps_make_of_the_first_stage(spark):
    """Line dedup, near copies, decontamination and pieces by plain loops over the quality stage's rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(d)
    shared = {k: max(ds) for k, ds in held.items() if len(k.decode()) >= 40 and len(ds) >= 5}
    rows = [(d, t if t is None else "\n".join(x for x in t.split("\n") if shared.get(key(x), d) == d)) for d, t in rows]
    first = {int(d): int(c) for d, c in plain_components(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    norm = lambda x: re.sub(r"[\s\u00a0]+", " ", (x or "").lower()).strip()
    items = [decontaminate.Pattern(norm(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if norm(r.text)]
    rows = [(d, t) for d, t in rows if not any(p.best(norm(t))[0] <= decontaminate.edit_budget(p.size) for p in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d, library.encode(t or "")) for d, t in rows)
    assert sorted((r.doc_id, list(r.piece_ids or [])) for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert {r.doc_id for r in now.collect()} <= {r.doc_id for r in odd.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_a_row_for_each_input_row(spark, name):
    table = {"op4_embedding_dedup": "embeddings", "op10_warc": "pages", "op12_centroids": "embeddings"}.get(name, "documents")
    found = QUERIES[name](spark, DATA)
    n = found.select("doc_id").distinct().count() if name == "op13_packing" else found.count()
    if name in ("op1_decontaminate", "op11_collocations"):
        assert n > 0
    else:
        assert n == spark.read.parquet(f"{DATA}/{table}.parquet").count()
