"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.llm import conversations, decontam, grouped_packing, html_text, imatch, merkle, ngram_join, packing, pii, quality_gam, secret_scan, sharding, toxicity_fm
from assayer.llm.common import crc32_fold, read, span_digest
from assayer.llm.oracles import GROUPS, OVERLAPS, PROOFS, REPAIRS, SHARDS as SHARDS_SQL
from assayer.plans.registry import Registry

LLM = Registry()

#: Vocabulary of the packing query; the file stays where it is installed.
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 24


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return os.environ.get("LLM_TOKENIZER") or public_tokenizers.path(name)


@LLM.add("op1_ngram_jaccard_join", GROUPS)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_groups(read(spark, folder, "documents"))


def with_verdict(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@LLM.add("op4_quality_gam")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = read(spark, folder, "documents"), crc32_fold("doc_id", 5)
    model = quality_gam.fit_quality(docs, read(spark, folder, "labels"), fold != 0)
    return with_verdict(quality_gam.score_quality(docs, model), fold == 0)


@LLM.add("op9_spaced_seed_decontamination", OVERLAPS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"), short_tolerance=True)
    return found.withColumn("share", F.round("share", 6))


@LLM.add("op10_toxicity_fm")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = read(spark, folder, "documents"), crc32_fold("doc_id", 4)
    model = toxicity_fm.fit_toxicity(docs, read(spark, folder, "labels"), fold != 2)
    return with_verdict(toxicity_fm.score_toxicity(docs, model), fold == 2)


@LLM.add("op2_imatch_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edit_report(read(spark, folder, "documents"))


@LLM.add("op3_weakly_supervised_pii")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, folder, "documents"))
    found = found.select("doc_id", "base", F.concat("base", "added").alias("spans"))
    base = tuple(pii.BASE)
    return found.select(
        "doc_id",
        *[F.size(spans_of(k, column="base")).cast("long").alias(f"n_{k}") for k in base],
        span_digest(spans_of(column="base")).alias("base_sha256"),
        F.array_join(spans_of(), ",").alias("spans"),
    )


def spans_of(*kinds: str, column: str = "spans") -> Column:
    """``kind:start:end`` of the spans, of all kinds or of those named."""
    spans = F.filter(column, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(column)
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


@LLM.add("op5_html_blocks")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read(spark, folder, "pages"))


@LLM.add("op6_secret_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, folder, "documents"))
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(spans_of(k)).cast("long").alias(f"n_{k}") for k in base],
        span_digest(spans_of(*base)).alias("base_sha256"),
        F.array_join(spans_of(), ",").alias("spans"),
    )


@LLM.add("op7_harmonic_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read(spark, folder, "documents"), tokenizer_path(), special_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@LLM.add("op8_rendezvous_sharding", SHARDS_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.assign_shards(read(spark, folder, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@LLM.add("op11_merkle_manifest", PROOFS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.col("doc_id").isNotNull() & (crc32_fold("doc_id", 7) == 0)
    leaves = merkle.document_leaves(read(spark, folder, "documents"), tampered=tampered)
    return merkle.verify_documents(merkle.Manifest(leaves))


@LLM.add("op12_conversation_repair", REPAIRS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations")
    return conversations.repair(conversations.damage(rows), rows.select("conv_id"))


@LLM.add("op13_grouped_packing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    packed = grouped_packing.pack(read(spark, folder, "documents"), tokenizer_path(), end_id=2)
    return packed.withColumn("length", F.col("length").cast("long"))
