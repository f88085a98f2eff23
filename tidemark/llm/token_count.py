"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, vocabulary

LIMIT = 1024


def _counts(path: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            n = np.fromiter((v.count(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column("text")), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens. Texts are read whole, however
    long, with white space of any length; a text of limit tokens is not over
    it. Rows are independent, so repeated rows and ids, null ones included,
    give repeated results, and nothing is shuffled. Other columns, whatever
    their names, are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_counts(path or default_path()), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
