"""The operators as queries over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import (
    chat_format, collocations, decontaminate, exact_dedup, fingerprints, language_id, license_scan, line_dedup, ngram_join, packing, secret_scan, spelling, toxicity,
)
from orrery.llm.sql import ORACLES  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"), spark)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels, spark)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), spark)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), spark, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, bench, spark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_labels(read(spark, sf_dir, "documents"), spark)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("phrases", lambda p: p["label"])
    spans = F.coalesce("spans", F.array().cast("array<struct<first: long, last: long, label: string, score: double>>"))
    at = F.transform("phrases", lambda p: p["pos"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(spans, lambda s: s["label"]))).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)))).alias("score"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs.select("doc_id", "text"), spark, min_words=1)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(read(spark, sf_dir, "documents"), spark, n=3, threshold=(9, 10))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labelled = docs.where(fold(4) != 2).select("text", "lang")
    return language_id.language_id(docs, labelled, spark).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat_format.digests(chat_format.prefix_target_examples(talks))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"), spark)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"), spark)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(read(spark, sf_dir, "documents").select("doc_id", "text"), spark)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_toxicity, op3_secret_scan, op4_packing, op5_decontaminate, op6_license_scan, op7_line_dedup, op8_ngram_join,
        op9_language_id, op10_chat_format, op11_spelling_variants, op12_collocations, op13_exact_dedup, pipeline,
    )
}
