"""The training-data operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, decontaminate, embedding_dedup, language_id, line_dedup, packing, piece_codec, quality, simhash, suffix_dedup, token_count, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its edit distance."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    trees = language_id.train(docs.where(~held_out).select("text", "lang"))
    found = language_id.predict(docs, trees)
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and whether decoding gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_pieces(docs, path, verify=True).select("doc_id", "n_pieces", "decodes_back", "piece_ids")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OPERATORS = (
    op1_decontaminate, op2_language_id, op3_token_count, op4_embedding_dedup, op5_piece_codec, op6_quality, op7_simhash_dedup, op8_line_dedup, op9_suffix_dedup, op10_warc,
    op11_collocations, op12_centroids, op13_packing,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLE_SQL = {
    "op11_collocations": collocations.oracle(),
    "op12_centroids": centroids.oracle(),
    "op4_embedding_dedup": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) n from v),
        links as (
            select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach as (select a node, b root from links union select r.node, l.b from reach r join links l on r.root = l.a),
        lowest as (select node, min(root) root from reach group by node),
        counts as (select a, count(*) n from links group by a)
        select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(root, vec_id)) component_id, vec_id = least(vec_id, coalesce(root, vec_id)) kept
        from embeddings left join counts on a = vec_id left join lowest on node = vec_id""",
    "op8_line_dedup": r"""
        with lines as (
            select d.doc_id, t.i, list_extract(d.parts, t.i) line
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents) d, unnest(range(1, len(d.parts) + 1)) t(i)),
        keyed as (
            select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
        shared as (select k, max(doc_id) top from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
        marked as (select keyed.*, shared.k is not null and doc_id <> top gone from keyed left join shared using (k))
        select doc_id, count(*)::bigint n_lines, (count(*) filter (gone))::bigint n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
        from marked group by doc_id""",
    "op10_warc": """
        with p as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) d from pages),
        g as (select d, max(page_id) top from p where octet_length(b) >= 1000 group by d)
        select page_id, octet_length(b)::bigint payload_bytes, p.d payload_digest, case when top is null or top = page_id then 'response' else 'revisit' end record_type,
            case when top <> page_id then top end refers_to
        from p left join g on p.d = g.d and octet_length(b) >= 1000""",
}
