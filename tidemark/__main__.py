"""python -m tidemark TEXTS VECTORS [OUT]: two line-aligned files through the topic engine, in batches of arrivals.

Writes where each document went and the texts of all topics as lines below OUT, and prints the counts of each batch.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import reports
from .operators.arrivals import arrivals
from .sources.paired import read_paired
from .storage import Workspace
from .streaming.engine import TopicStream


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemark", description="Evolving topics of documents with vectors.")
    p.add_argument("texts", nargs="?", default="dataset/short_texts.txt")
    p.add_argument("vectors", nargs="?", default="dataset/short_vectors.csv")
    p.add_argument("out", nargs="?", default="topics")
    p.add_argument("--batch", type=int, default=10_000, help="arrivals that a batch holds")
    usual = Settings()
    for name in ("dim", "check", "k", "subscriptions", "publications"):
        p.add_argument(f"--{name}", type=int, default=getattr(usual, name))
    for name in ("alpha", "beta"):
        p.add_argument(f"--{name}", type=float, default=getattr(usual, name))
    return p.parse_args(args)


def run(spark: SparkSession, options: argparse.Namespace) -> TopicStream:
    """The files' documents subscribe and then publish, as settings say; what still waits is assigned at the end."""
    names = ("dim", "check", "k", "subscriptions", "publications", "alpha", "beta")
    settings = Settings(**{n: getattr(options, n) for n in names})
    rows = read_paired(spark, options.texts, options.vectors, settings.dim)
    # arrivals number the rows of the file; the document of each is looked up by that row
    events = arrivals(rows.select("seq"), settings).join(rows.withColumnRenamed("seq", "row"), "row")
    events = Workspace(spark, "arrivals").table(events.select("seq", "kind", "doc_id", "tokens", "v"), "events")
    engine = TopicStream(spark, settings)
    engine.replay(events, options.batch)
    write(engine, options.out)
    return engine


def write(engine: TopicStream, out: str) -> None:
    placed: DataFrame = engine.table("assigned").select("doc_id", "topic_id").union(engine.flush())
    placed.write.mode("overwrite").option("header", True).csv(f"{out}/assigned")
    lines = reports.text_lines(engine.table("text"))
    reports.write_lines(lines.select(F.concat_ws("\t", "topic_id", "line").alias("line")), f"{out}/topics")


if __name__ == "__main__":
    for batch in run(SparkSession.builder.getOrCreate(), arguments()).progress:
        print(json.dumps(batch))
