"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm import bpe_stream, fm_quality, hilbert, html_extract, jaccard_join, lang_gru, license_scan, mixing_fill, posting_lists, segment_topk, token_count, token_overlap, turn_repair, vectors
from quillweave.llm.common import table, tokenizer_file

EVERY_50TH = "vec_id % 50 = 0"


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), F.expr(EVERY_50TH), 5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_stream.encode_digests(docs, tokenizer_file("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_count.over_limit(token_count.token_counts(docs, tokenizer_file("piece_bpe_32k.model")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fm_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = fm_quality.score(docs, machine, threshold=0.7)
    return scored.select("doc_id", fm_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(vectors.usable("embedding"))
    scaled = rows.withColumn("embedding", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")))
    return segment_topk.top_products(scaled, F.expr(EVERY_50TH), 5)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing_fill.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.linked(table(spark, sf_dir, "documents"))
    return groups.withColumnRenamed("component", "component_id")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard(table(spark, sf_dir, "documents"), 8, law="rows")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(rows).withColumnRenamed("conv", "conv_id")


def op12_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_overlap.overlaps(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_lang_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = lang_gru.predict(docs, lang_gru.fit(docs))
    return said.select("doc_id", fm_quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_posting_lists": op1_posting_lists,
    "op2_license_scan": op2_license_scan,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_html_text": op4_html_text,
    "op5_fm_quality": op5_fm_quality,
    "op6_segment_topk": op6_segment_topk,
    "op7_source_mix": op7_source_mix,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_overlap": op12_token_overlap,
    "op13_lang_gru": op13_lang_gru,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.scan_sql(),
    "op6_segment_topk": segment_topk.top_products_sql(),
    "op7_source_mix": mixing_fill.mixed_sizes_sql(),
    "op9_jaccard_join": jaccard_join.linked_sql(),
}
