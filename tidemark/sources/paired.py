"""Readers: texts and vectors in line-aligned files, and the same from Parquet tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.text import BUCKETS, parse_floats, tokens
from ..functions.vectors import as_doubles


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of the lines of a text file, or of a folder's files by name, from 0.

    Spark deals files in parts by size, in an order of its own. Lines are
    numbered inside the part that a task reads, and each part's start comes
    from a sum over parts: one row each, so that no task holds all lines.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *where).withColumn("at", F.monotonically_increasing_id())
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(starts, ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("seq"), "value")


def pair_lines(texts: DataFrame, numbers: DataFrame, dim: int | None = None) -> DataFrame:
    """(doc_id, seq, tokens, v) of lines (seq, value) of texts and of vectors; see read_paired."""
    texts = texts.select("seq", tokens(F.col("value")).alias("tokens"))
    found = numbers.select("seq", as_doubles(parse_floats(F.col("value"))).alias("v"))
    out = texts.join(found, "seq").select((F.col("seq") + 1).alias("doc_id"), "seq", "tokens", "v")
    return out.filter(F.size("v") == dim) if dim else out


def read_paired(spark: SparkSession, text_path: str, vector_path: str, dim: int | None = None, strict: bool = False) -> DataFrame:
    """(doc_id, seq, tokens, v): line i of one file with line i of the other, up to the shorter one.

    Cells of a vector line that are no numbers are dropped; with dim, rows
    whose vectors are of another length are left out. With strict, files of
    different lengths are a ValueError; that reads both once more.
    """
    if strict:
        n, m = (spark.read.text(p).count() for p in (text_path, vector_path))
        if n != m:
            raise ValueError(f"{n} texts and {m} vectors")
    return pair_lines(numbered_lines(spark, text_path), numbered_lines(spark, vector_path), dim)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, topic_id, v) of the embeddings table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("topic_id"), as_doubles(F.col("embedding")).alias("v"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", tokens(F.col("text")).alias("tokens"))


def _histograms(batches):
    """(doc_id, v) of rows (doc_id, tokens): how many tokens fall into each bucket, the first byte of a token's MD5."""
    for batch in batches:
        lists = batch.column("tokens")
        words = pc.list_flatten(lists).dictionary_encode()
        bucket = np.array([hashlib.md5(w.encode()).digest()[0] for w in words.dictionary.to_pylist()], dtype=np.int64)
        cells = pc.list_parent_indices(lists).to_numpy() * BUCKETS + bucket[words.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(lists) * BUCKETS).astype(np.float64)
        ends = np.arange(len(lists) + 1, dtype=np.int32) * BUCKETS
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))], names=["doc_id", "v"])


def token_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, v) of rows (doc_id, tokens): hashed term frequencies. A row is counted where it lies and vectors alone are
    shuffled, for the sum over rows of one doc_id. Rows without tokens have none."""
    ship(rows.sparkSession)
    some = rows.filter(F.size("tokens") > 0).select("doc_id", "tokens")
    found = some.mapInArrow(_histograms, f"doc_id {dict(some.dtypes)['doc_id']}, v array<double>")
    found = found.groupBy("doc_id").agg(F.collect_list("v").alias("vs"))
    return found.select("doc_id", F.aggregate(F.slice("vs", 2, F.size("vs")), F.col("vs")[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias("v"))


def with_vectors(rows: DataFrame) -> DataFrame:
    """(doc_id, tokens, v) of rows (doc_id, text) that have tokens. Texts are moved as they are: their tokens are larger."""
    found = token_counts(rows.select("doc_id", tokens(F.col("text")).alias("tokens")))
    return rows.select("doc_id", "text").join(found, "doc_id").select("doc_id", tokens(F.col("text")).alias("tokens"), "v")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, v): hashed term frequencies of whole texts."""
    return token_counts(documents(spark, sf_dir))
