"""What the corpus pipeline does with each operator: (spark, docs, sf_dir) -> DataFrame.

All but the last keep the columns of documents. Null and empty texts pass through every stage; the
near-duplicate stage takes all texts without a word as copies of each other. Rows with a null doc_id
are documents like any other, and come last where the smallest doc_id stays; unlike texts of one doc_id
are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import common, importance, packing, simhash, suffix, winnowing

#: Five-word shingles, 256 bits. A similarity of 0.8 leaves 39 differing bits on average, with a standard deviation of 6, and up to 48 in
#: texts of few shingles; unrelated texts differ in 128.
WORDS, LANES, RADIUS = 5, 4, 76
#: 24 buckets of 6 minima: of pairs at a similarity of 0.8, 7 in 10,000 share none.
BANDS, ROWS = 24, 6
#: Words of a passage, of over 50, and of its strings of which the least is kept.
PASSAGE, PASSAGE_GRAM = 51, 32


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return importance.Classifier(docs, common.read(spark, sf_dir, "labels")).keep(docs)


def ranked_id() -> Column:
    """doc_id; for null a number of 2**62 or more that the text gives, so that such rows come last and spread over the tasks."""
    return F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the text of the smallest doc_id stays, once; two unlike texts of one doc_id, or without one, are two documents."""
    classes = simhash.near_copies(docs.select(ranked_id().alias("doc_id"), "text"), WORDS, LANES, RADIUS, BANDS, ROWS)
    stays = classes.groupBy("home").agg(F.min(F.struct("doc_id", "key")).alias("one")).select("one.*")
    rows = docs.select(F.struct("*").alias("row"), ranked_id().alias("doc_id"), F.xxhash64("text").alias("key"))
    known = rows.join(stays, ["doc_id", "key"], "left_semi")
    # Rows with one doc_id and text may differ in other columns; a hash of these picks one.
    others = [F.xxhash64(F.to_json(F.struct(F.col(f"row.`{c}`")))) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.hash(*others) if others else F.lit(0)))
    return known.withColumn("first", first).filter("first = 1").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of words that stand elsewhere too are cut out, the document stays."""
    return suffix.cut_from(docs, PASSAGE, PASSAGE_GRAM, words=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a row is known by a 64-bit hash of its doc_id and text, so no row goes for another's text."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text")
    found = winnowing.contamination(keyed, common.read(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(found, key == found.hit, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents in token-budget batches."""
    lengths, _ = common.cut(packing.word_lengths(docs), "lengths")
    return packing.pack(lengths)
