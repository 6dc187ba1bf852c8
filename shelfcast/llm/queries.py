"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosstok, decontam, hardneg, htmltext, linededup, pii, quality, reshard, simhash, tokenstore, topk, urlfilter
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id")))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    manifest, dictionary = tokenstore.write(table(spark, sf_dir, "documents"),
                                            public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenstore.read(manifest, dictionary, tokenstore.digest,
                           "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plan = reshard.Plan(docs, reshard.old_layout(), reshard.OLD_SHARDS, reshard.NEW_SHARDS)
    # Every row is reported from the files of the new shards.
    return plan.write(docs).select(
        "doc_id", reshard.size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                      public_tokenizers.path("byte_bpe_50k.json"), digests=True, ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "n_deleted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", noisy), lambda vec_id: vec_id % 100 == 0)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return crosstok.Alignment(table(spark, sf_dir, "documents").select("doc_id", "text"),
                              *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))).documents()


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.said("base_spans"), 256).alias("base_sha256"),
                        pii.said("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_simhash_near_dedup, op3_exact_topk, op4_token_binary, op5_flow_resharding,
    op6_url_filter, op7_bpe, op8_benchmark_decontamination, op9_html_extraction, op10_line_dedup,
    op11_hard_negatives, op12_cross_tokenizer, op13_pii)}

ORACLES = {
    "op3_exact_topk": topk.ORACLE,
    "op6_url_filter": urlfilter.ORACLE,
    "op11_hard_negatives": hardneg.ORACLE,
    "op10_line_dedup": linededup.oracle_sql("SELECT doc_id, text, n_deleted FROM deduped"),
}
