"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, linededup, lm_quality, manifest, packing, periods, quality, sharding, simhash, tokenfile, urlgraph
from .common import ascii_lower, crc32_of_id, lasting_folder, shared_folder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = lasting_folder(spark, "slot-maps", sf_dir, "bytes", "8")  # a later run starts from the last version
    placed, used = sharding.shard_by_slots(table(spark, sf_dir, "documents"), 8, map_path=maps)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.lit(used.version).alias("map_version"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measure_and_judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col(f"quality.{c}") for c in quality.BASE[:5]), "base_failed", "kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumns({"log_perplexity": F.round("log_perplexity", 6), "perplexity": F.round("perplexity", 4)})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), profiles, keep_text=False)
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_repeated_lines(docs)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.col("overlap.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"), F.size("overlap.items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc32_of_id(F.col("doc_id")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = manifest.prove_documents(table(spark, sf_dir, "documents"), held={"text": tampered})
    return found.select(F.col("id").alias("doc_id"), *(f.name for f in manifest.PROOF))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return tokenfile.read(spark, folder, with_ids=False).withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.detect(docs.withColumn("text", periods.periodic_from("text", crc32_of_id(F.col("doc_id")))), with_text=False)
    best = F.col("periods.strongest")
    numbers = [best[c].alias(c) for c in ("start", "length", "period")] + [F.expr("periods.strongest.length * 1000 div periods.strongest.period").alias("exponent_milli")]
    return found.select("doc_id", F.size("periods.runs").cast("long").alias("n_runs"), *numbers, "periods.runs_sha256", "periods.collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_extraction, op2_sharding, op3_simhash_near_dedup, op4_quality_rules, op5_best_fit_packing, op6_quality_classifier, op7_language_id, op8_url_filters, op9_line_dedup, op10_benchmark_decontamination, op11_merkle_manifest, op12_token_files, op13_periodic_runs)
    return {f.__name__: f for f in ops}
