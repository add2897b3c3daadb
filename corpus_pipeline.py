"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all documents that the one before has kept and takes (spark, docs, sf_dir). All
but the last return the columns of `documents`. Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionflow.llm import decontaminate, language, ngram_join, packing, privacy
from auctionflow.llm.common import chosen
from auctionflow.session import store

MIN_SCORE = 0.4  # least probability of the best language
KEY = "_document"  # what a row is known by while copies are looked for


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go; `lang` becomes the predicted one."""
    model = language.train(docs)
    found = language.identify(docs, model).filter(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 in five-word sets, the one with the
    smallest id stays, once. Documents without words or without an id are in no group. Rows that share an
    id but not the text are documents of their own; of equal ids the one whose text has the smaller hash counts as smaller."""
    sums = F.xxhash64("text")
    clashing = store(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sums).alias("a"), F.max(sums).alias("b"))
                     .filter("a <> b").select("doc_id"), "clashing")
    own = docs.withColumn(KEY, F.col("doc_id").cast("long"))
    unique = clashing.isEmpty()
    if not unique:
        marked = docs.join(clashing.withColumn(KEY, F.lit(True)), "doc_id", "left")
        own = marked.withColumn(KEY, F.when(F.col(KEY), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).select(*docs.columns, KEY)
    texts = own.select(F.col(KEY).alias("doc_id"), "text")
    groups = store(ngram_join.ngram_groups(texts, words=5, percent=80), "groups").withColumnRenamed("doc_id", KEY)
    gone = groups.filter(f"{KEY} <> component_id").select(KEY)
    if not unique:
        first = groups.filter("n_shingles > 0").join(own.select(KEY, "doc_id").distinct(), KEY).groupBy("component_id").agg(
            F.min(F.struct("doc_id", KEY)).alias("first"))
        gone = store(groups.join(first, "component_id").filter(F.col(KEY) != F.col(f"first.{KEY}")).select(KEY), "gone")
    kept = chosen(own, gone, "left_anti", KEY)
    repeated = store(groups.filter("n_shingles > 0").groupBy(KEY).count().filter("count > 1").select(KEY), "repeated")
    if not repeated.isEmpty():
        kept = chosen(kept, repeated, "left_anti", KEY).unionByName(chosen(kept, repeated, "left_semi", KEY).dropDuplicates([KEY]))
    return kept.select(docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, substitutions allowed, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms; n_chars is counted anew."""
    hidden = privacy.pseudonymise(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 1,024 tokens, with their token ids."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: None of the stages can be stated in SQL; tests/llm compares the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
