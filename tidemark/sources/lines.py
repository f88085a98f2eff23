"""A data source of lines by byte ranges, batch and stream, and a sink of line-aligned files that commits as a whole.

Files are reached through pyarrow's file systems, so paths may be URIs. A
folder that the sink has written holds a list of the files that belong to it,
put there last; what failed tasks have left is not on it and is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..deploy import ship

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
LIST = "_committed"


class Range(InputPartition):
    """The lines of a file that start in bytes first to last, last excluded."""

    def __init__(self, file: str, first: int, last: int):
        super().__init__(None)
        self.file, self.first, self.last = file, first, last


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files by name: the listed ones of a committed folder, else all but hidden ones."""
    fs, path = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    folder, _, _ = path.rstrip("/").rpartition("/")
    for root, prefix in ((path.rstrip("/"), ""), (folder, path.rstrip("/").rpartition("/")[2] + "/")):
        if fs.get_file_info(f"{root}/{LIST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{LIST}") as f:
                names = [n for n in json.loads(f.read()) if n.startswith(prefix)]
            return [(f"{root}/{n}", fs.get_file_info(f"{root}/{n}").size) for n in sorted(names)]
    found = [f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size) for f in found)


def _ranges(file: str, first: int, last: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, last)) for a in range(first, last, size)]


def _lines(fs: pafs.FileSystem, part: Range) -> Iterator[bytes]:
    """The lines that start in a range: the first one after a line end, and to the end of the one that the range cuts."""
    with fs.open_input_file(part.file) as f:
        at = part.first - 1 if part.first else 0
        f.seek(at)
        held: list[bytes] = []  # pieces of a line that goes on
        skipping = bool(part.first)  # the line before belongs to the range before
        while chunk := f.read(CHUNK):
            pieces = chunk.split(b"\n")
            for k, piece in enumerate(pieces):
                ends = k < len(pieces) - 1
                held.append(piece)
                if not ends:
                    continue
                line, held = b"".join(held), []
                if not skipping:
                    yield line
                skipping = False
                at += len(line) + 1
                if at >= part.last:
                    return
        if held != [b""] and held and not skipping and at < part.last:
            yield b"".join(held)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        return [r for file, n in _files(self.path) for r in _ranges(file, 0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for k, line in enumerate(_lines(fs, partition)):
            yield partition.file, partition.first, k, line.decode("utf-8", "replace").removesuffix("\r")


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the bytes of whole lines of each file, so that a line counts once, when it is complete."""

    def initialOffset(self):
        return {}

    def latestOffset(self):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        out = {}
        for file, n in _files(self.path):
            with fs.open_input_file(file) as f:
                end = n
                while end > 0:  # back to the last line end
                    start = max(0, end - CHUNK)
                    f.seek(start)
                    if (cut := f.read(end - start).rfind(b"\n")) >= 0:
                        out[file] = start + cut + 1
                        break
                    end = start
        return out

    def partitions(self, start, end):
        return [r for file in sorted(end) for r in _ranges(file, start.get(file, 0), end[file], self.size)]

    def commit(self, end):
        pass


class LineSource(DataSource):
    """format("tidemark_lines"): (file, block, at, value), line number ``at`` of those that start in the range from byte
    ``block``. Lines end with \\n, of which a \\r before it is no part; bytes that are no UTF-8 become U+FFFD. Option
    rangeBytes is the size of a range. As a stream it takes what is appended, once."""

    @classmethod
    def name(cls):
        return "tidemark_lines"

    def schema(self):
        return "file string, block long, at long, value string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, options, columns, overwrite):
        self.path, self.columns, self.overwrite, self.run = options["path"].rstrip("/"), columns, overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator):
        fs, path = pafs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.run}-{task.taskAttemptId()}"
        files = []
        for c in self.columns:
            fs.create_dir(f"{path}/{c}", recursive=True)
            files.append(fs.open_output_stream(f"{path}/{c}/{name}"))
        for row in iterator:
            for file, c in zip(files, self.columns, strict=True):
                value = row[c] or ""
                if "\n" in value or "\r" in value:
                    raise ValueError(f"a line of {c} holds a line end")
                file.write(value.encode() + b"\n")
        for file in files:
            file.close()
        return _Written([f"{c}/{name}" for c in self.columns])

    def commit(self, messages):
        fs, path = pafs.FileSystem.from_uri(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        fs.create_dir(path, recursive=True)
        old = []
        if fs.get_file_info(f"{path}/{LIST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{LIST}") as f:
                old = json.loads(f.read())
        if not self.overwrite:
            names, old = old + names, []
        draft = f"{path}/.{LIST}-{self.run}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(sorted(names)).encode())
        fs.move(draft, f"{path}/{LIST}")
        for n in old:
            fs.delete_file(f"{path}/{n}")

    def abort(self, messages):
        fs, path = pafs.FileSystem.from_uri(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(f"{path}/{n}")


class AlignedSink(DataSource):
    """format("tidemark_aligned"): a folder of files for each column, strings without line ends (a ValueError), so that
    line i of a file belongs to line i of the files of the same name in the other folders. Null is an empty line."""

    @classmethod
    def name(cls):
        return "tidemark_aligned"

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LineSource)
    spark.dataSource.register(AlignedSink)


def write_aligned(rows: DataFrame, order: str, path: str, files: int | None = None) -> None:
    """Writes the columns of rows but ``order`` as line-aligned files; files by name hold the rows in that order. Spark
    chooses by size how many files a column has, if they aren't given."""
    register(rows.sparkSession)
    dealt = rows.repartitionByRange(files, order) if files else rows.repartitionByRange(order)
    dealt.sortWithinPartitions(order).drop(order).write.format("tidemark_aligned").mode("overwrite").save(path)


def numbered(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(seq, value) of the lines below a path, from 0, in the order of the names of files. Ranges are numbered by a sum over
    their counts, one row a range."""
    register(spark)
    lines = spark.read.format("tidemark_lines").option("rangeBytes", range_bytes).load(path)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["file", "block"]).select((F.col("start") + F.col("at")).alias("seq"), "value")
