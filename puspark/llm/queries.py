"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puspark.llm import alignment, bpe, conversations, decontaminate, embedding_dedup, language, line_dedup, mixing, near_duplicates, pii, quality, url_filter, warc
from puspark.sources import materialise, read_table
from puspark.sources.shared import table_path


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.sanitise(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < pii.BASE_KINDS)
    return found.select(
        "doc_id",
        *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS[: pii.BASE_KINDS]],
        F.sha2(pii.spelled(base), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
    )


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, folder, "documents"), k=4, percent=80)


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    x = materialise(quality.measured(read_table(spark, folder, "documents")))
    model = quality.fit(x, read_table(spark, folder, "labels"))
    return quality.scored(x, model).select(
        "doc_id", (quality.held_out_rest("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_removed", "text")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = language.fit(docs.filter(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read_table(spark, folder, "pages").select("page_id", "url"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = table_path(spark)
    warc.write(read_table(spark, folder, "pages"), path)
    records = warc.read(spark, path)
    response = F.col("record_type") == "response"
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, folder, "embeddings"))


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(read_table(spark, folder, "documents"), path)
    return bpe.decode(encoded, path, keep=("doc_id", "ids")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
    return alignment.align(read_table(spark, folder, "documents"), *files).select(*columns)


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.prefix_trie(read_table(spark, folder, "conversations"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_mix": op5_mix,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_urls": op8_urls,
    "op9_warc": op9_warc,
    "op10_embeddings": op10_embeddings,
    "op11_bpe": op11_bpe,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
}
