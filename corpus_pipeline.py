"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept. The first four return the rows they keep with the columns of
their input, whatever other columns it has; the last returns what the mix takes.

* language_id: texts of no language known to a model fitted on the table's own labels go (no letter, or a score under
  the floor that held-out labelled texts of that length set). Null texts go. Without any label all stay.
* quality: texts over their language's perplexity threshold, under a model of the trusted ones among them, go. Rows of
  equal text and language go or stay together; null texts stay.
* near_duplicates: of each group linked by five-word shingles at Jaccard 0.8 or more the row of the smallest id stays
  (null ids come last; of rows of that id the least by a digest of the row). Rows are told apart by that digest of all
  their columns, not by id: rows of one id with different texts are judged each by its own text, rows with a null id as
  all others. Of rows equal in all columns one stays. Texts without a word link with nothing.
* decontamination: contaminated texts go. Null texts stay.
* mix: source, size, source_size, target, epochs and taken words of each document of which the mix takes any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import decontamination, jaccard_join, language_id, mixing, quality, registry
from lumengrid.llm.common import few, free_name, lookup, stored, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name(docs, "language")
    model = language_id.train_with_floors(docs)
    if not model.languages:
        return docs
    scored = docs.withColumn(found, language_id.predict(docs, model))
    return scored.where(language_id.believed(F.col(found), F.col("text"), model)).select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    one, two, lang = (free_name(docs, n) for n in ("text_1", "text_2", "text_lang"))
    gone = judged.where("NOT kept").select(F.col("text_1").alias(one), F.col("text_2").alias(two), F.coalesce("lang", F.lit("")).alias(lang)).distinct()
    digest = quality.digest("text")
    keyed = docs.withColumns({one: digest[0], two: digest[1], lang: F.coalesce("lang", F.lit(""))})
    return keyed.join(few(stored(gone, "rejected")), [one, two, lang], "left_anti").select(*docs.columns)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, number = free_name(docs, "row_digest"), free_name(docs, "row_number")
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn(row, F.xxhash64(*plain))
    linked = stored(jaccard_join.links(keyed, key=row, carry={number: "doc_id"}).select(F.col("doc_id").alias(row), F.col(number).cast("long").alias(number), "component_id"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col(number).isNull().alias("last"), number, row)).alias("first"), F.count(F.lit(1)).alias("n"))
    others = lookup(linked, stored(first.where("n > 1"), "first"), ["component_id"], "n").where(F.col("first").isNotNull() & (F.col(row) != F.col("first")[row]))
    gone = stored(others.select(row).distinct(), "gone")
    left = keyed.join(few(gone), row, "left_anti")
    twice = stored(linked.groupBy(row).count().where("count > 1").select(row), "twice")
    if twice.isEmpty():
        return left.select(*docs.columns)
    once, again = left.join(few(twice), row, "left_anti"), left.join(few(twice), row, "left_semi")
    return once.unionByName(again.dropDuplicates([row])).select(*docs.columns)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name(docs, "hits")
    scanned = docs.withColumn(found, decontamination.occurrences(docs, table(spark, sf_dir, "benchmark")))
    return scanned.where(~decontamination.contaminated(F.col(found))).select(*docs.columns)


def by_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, ratings=registry.ratings(table(spark, sf_dir, "labels"))).where("taken > 0")


STAGES = [("language_id", by_language), ("quality", by_quality), ("near_duplicates", by_near_duplicates), ("decontamination", by_benchmark), ("mix", by_mix)]

#: The language and quality models aren't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
