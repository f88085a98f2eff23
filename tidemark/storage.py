"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Workspaces of the open scratch blocks of this thread, outermost first.
_scratch: ContextVar[tuple[list[Workspace], ...]] = ContextVar("scratch", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Workspaces made inside, by this thread, go when the block ends, so what is read later must have been written elsewhere."""
    mine: list[Workspace] = []
    token = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(token)
        for work in mine:
            work.clear()


class Workspace:
    """Tables of one operator run, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        if open_ := _scratch.get():
            open_[-1].append(self)

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes df, with the writer's options, and reads it again: lineage ends here, and a lost executor costs nothing before it."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As table(), laid out so that joins on key need not move these rows. df should be dealt by key already."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tidemark_{name}_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}-bucketed"
        df.write.option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out._tidemark_path, out._tidemark_table = path, table
        self._tables.append(table)
        return out

    def dealt(self, df: DataFrame, name: str, key: str, few: bool = False) -> DataFrame:
        """As table(), in one folder for each value of key, so that a filter on it reads no other rows. Of few values, each
        task writes its own rows; of many, rows are dealt by value first, for fewer files."""
        path = f"{self.path}/{name}-dealt"
        (df if few else df.repartition(key)).write.partitionBy(key).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_dealt(self, name: str, key: str, value) -> None:
        """Removes the rows of one value of dealt()."""
        self._delete(f"{self.path}/{name}-dealt/{key}={value}")

    def clear(self) -> None:
        """Removes all tables."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for t in tables:
            if hasattr(t, "_tidemark_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._tidemark_table}")
            self._delete(t._tidemark_path)
