"""The corpus pipeline: each stage reads the documents that the one before kept.

1. language: documents without letters, and longer ones in which no language
   has a clear share of the words, go.
2. near_duplicates: one document of each group of near copies stays.
3. repeated_passages: passages of 35 words and more that occur again are cut
   out of all texts; documents of which nothing is left go.
4. source_mix: documents are taken as often as their source's target asks for,
   each a row, so that a document taken twice is two rows.
5. packing: the pieces of training sequences.

All stages but the last return the columns of documents; other columns, whatever
their names, are dropped by the first stage that meets them. Texts of any length
are read whole. Rows with a null id stay rows of their own; a null text has no
letters and goes with the first stage. Repeated rows are copies, of which one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.deploy import ship
from tidemark.llm.crf_language import UNKNOWN, identify_language
from tidemark.llm.minhash_forest import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack_documents
from tidemark.llm.phrase_automata import remove_repeats
from tidemark.storage import Workspace, scratch

#: A text of so many words or more goes if no language has this share of them.
MIXED_WORDS = 20
MIXED_SHARE = 0.45

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = identify_language(docs.select(*COLUMNS), keep=True)
    words = F.aggregate("labelled", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    mixed = (words >= MIXED_WORDS) & (F.col("score") < MIXED_SHARE)
    return found.filter((F.col("lang_pred") != UNKNOWN) & ~mixed).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Ids are expected to be unique. If one isn't, rows of one id may be different
    texts, so each (id, text) is a node of its own and any one of a group stays.
    """
    ship(spark)
    unique = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    key = F.col("doc_id") if unique else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(*COLUMNS, key.alias("_key"))
    copies = near_duplicates(keyed, id_col="_key").filter("NOT kept").select("_key")
    kept = keyed.join(copies, "_key", "left_anti")
    if not unique:
        kept = kept.filter("_key IS NOT NULL").dropDuplicates(["_key"]).union(kept.filter("_key IS NULL"))
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = remove_repeats(docs)
    emptied = (F.col("n_words") > 0) & (F.length("text") == 0)
    return left.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs, carry=COLUMNS).filter("repeats > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("carried.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", deduplicated),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: No SQL: language, near copies and repeated passages have none. Tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again; what a stage and its operators wrote goes when the next one is done."""
    work = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            then, docs = docs, work.table(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            work.drop(then)
    return docs
