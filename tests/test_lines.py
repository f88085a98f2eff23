"""Lines by byte ranges, appended lines in a stream, and the sink of aligned files."""

import os

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import lines
from tidemark.sources.lines import LIST, Range, _lines, numbered, register, write_aligned

TEXT = "one\ntwo words\n\nfünf\r\nsix" + "x" * 300 + "\n\nlast"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("text", [TEXT, TEXT + "\n", "", "\n", "\n\na"])
def test_every_line_is_in_one_range(tmp_path, monkeypatch, size, text):
    import pyarrow.fs as pafs

    monkeypatch.setattr(lines, "CHUNK", 16)
    data = text.encode()
    (tmp_path / "f").write_bytes(data)
    found = [x for a in range(0, len(data), size) for x in _lines(pafs.LocalFileSystem(), Range(str(tmp_path / "f"), a, min(a + size, len(data))))]
    assert found == data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]


def test_numbered_over_files_and_ranges(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "b").write_text("".join(f"b{i}\n" for i in range(200)))
    (tmp_path / "in" / "a").write_text("a0\na1")
    (tmp_path / "in" / "_hidden").write_text("no\n")
    found = numbered(spark, f"file://{tmp_path}/in", 64)
    want = ["a0", "a1"] + [f"b{i}" for i in range(200)]
    assert [tuple(r) for r in found.orderBy("seq").collect()] == list(enumerate(want))
    with pytest.raises(PySparkException):
        numbered(spark, str(tmp_path / "absent")).count()


def test_sink_commits_aligned_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(i, f"text {i}", None if i % 7 == 0 else f"{i},{i}") for i in range(500)]
    write_aligned(spark.createDataFrame(rows, "i long, t string, v string").repartition(5), "i", path, 5)
    assert len(os.listdir(tmp_path / "out" / "t")) > 1
    (tmp_path / "out" / "t" / "part-000000-left-by-a-failed-task").write_text("no\n")
    t, v = (numbered(spark, f"{path}/{c}", 100).withColumnRenamed("value", c) for c in "tv")
    assert [tuple(r) for r in t.join(v, "seq").orderBy("seq").collect()] == [(i, a, b or "") for i, a, b in rows]
    before = (tmp_path / "out" / LIST).read_text()
    with pytest.raises(PySparkException):
        write_aligned(spark.createDataFrame([(1, "two\nlines", "1")], "i long, t string, v string"), "i", path)
    assert (tmp_path / "out" / LIST).read_text() == before
    write_aligned(spark.createDataFrame(rows[:3], "i long, t string, v string"), "i", path)
    assert numbered(spark, f"{path}/t").count() == 3
    assert {n for n in os.listdir(tmp_path / "out" / "v") if f"v/{n}" in before} == set()


def test_stream_takes_appended_lines_once(spark, tmp_path):
    register(spark)
    os.mkdir(tmp_path / "in")
    file = tmp_path / "in" / "f"

    def run():
        # the rate of triggers is up to the stream; each run takes what is there and stops
        q = spark.readStream.format("tidemark_lines").option("rangeBytes", 8).load(f"file://{tmp_path}/in").select("value").writeStream
        q = q.format("parquet").option("path", str(tmp_path / "found")).option("checkpointLocation", str(tmp_path / "offsets")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "found")).collect())

    file.write_text("a\nb\nhalf")
    assert run() == ["a", "b"]
    with file.open("a") as f:
        f.write(" a line\nc\n")
    (tmp_path / "in" / "g").write_text("g\n")
    assert run() == ["a", "b", "c", "g", "half a line"]
    assert run() == ["a", "b", "c", "g", "half a line"]
