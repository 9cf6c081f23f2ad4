"""Registered queries of this subpackage: name -> (Spark builder, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, chat, decontaminate, embeddings, html, lm, mixing, packing, quality, simhash, spelling, suffix_dedup, toxicity
from .common import table

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_html_extraction(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.chat_digest(chat.format_chats(turns))


def op3_embedding_near_dedup(spark, sf_dir):
    return embeddings.embedding_components(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op7_lm_scoring(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark, sf_dir):
    return align.alignment_counts(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_chat_formatting": (op2_chat_formatting, chat.CHAT_SQL),
    "op3_embedding_near_dedup": (op3_embedding_near_dedup, embeddings.PIGEONHOLE_SQL),
    "op4_toxicity": (op4_toxicity, None),
    "op5_simhash_near_dedup": (op5_simhash_near_dedup, None),
    "op6_source_mixing": (op6_source_mixing, mixing.MIX_SQL.replace("{docs}", "documents")),
    "op7_lm_scoring": (op7_lm_scoring, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_decontamination": (op9_decontamination, decontaminate.DECONTAMINATION_SQL),
    "op10_suffix_array_dedup": (op10_suffix_array_dedup, None),
    "op11_tokenizer_alignment": (op11_tokenizer_alignment, None),
    "op12_best_fit_packing": (op12_best_fit_packing, None),
    "op13_spelling_variants": (op13_spelling_variants, None),
}
