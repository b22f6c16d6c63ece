"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, jaccard_join, language_id, licenses, mixing, preferences, quality, token_counts, toxicity
from .common import table


def fold(parts: int, key: str = "doc_id") -> Column:
    """The remainder that deals rows to learning and held-out parts."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(3) != 1))
    return docs.select("doc_id", (fold(3) == 1).alias("held_out"), language_id.predict(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(mask)


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preferences.pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 1)
    return pairs.select("pair_id", "n_prompt", "prompt", "chosen", "rejected", _spans("chosen_mask"), _spans("rejected_mask"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", licenses.licences(docs, licenses.train(docs)).alias("found"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select("doc_id", F.size("found").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("score"))


def ratings(labels: DataFrame) -> DataFrame:
    """Sampling weights: 1 for good and 0.25 for bad documents; what isn't rated gets the default."""
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") > 0, 1.0).otherwise(0.25).alias("quality"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ratings=ratings(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts.counts(docs).alias("t")).select("doc_id", "t.n_words", "t.n_tokens")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "perplexity", "nll", "threshold", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    settings = toxicity.Settings()
    rows = toxicity.sample(docs, table(spark, sf_dir, "labels"), fold(4, "rated_id") != 2, settings)
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows], settings)
    scored = docs.select("doc_id", (fold(4) == 2).alias("held_out"), toxicity.predict(docs, model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", decontamination.occurrences(docs, table(spark, sf_dir, "benchmark")).alias("f"))
    f = F.col("f")
    return found.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), decontamination.contaminated(f).alias("contaminated"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "component_id", "kept")


def queries() -> dict:
    from corpus_pipeline import run

    ops = (op1_language_id, op2_preference_pairs, op3_license_scan, op4_source_mix, op5_token_counts, op6_quality_classifier, op7_toxicity, op8_decontamination, op9_embedding_dedup, op10_jaccard_join)
    return {f.__name__: f for f in ops} | {"pipeline": run}


def oracle_sql() -> dict:
    return {"op2_preference_pairs": preferences.ORACLE, "op4_source_mix": mixing.ORACLE, "op5_token_counts": token_counts.ORACLE, "op8_decontamination": decontamination.ORACLE, "op9_embedding_dedup": embedding_dedup.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE}
