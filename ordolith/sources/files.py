"""Lines and binary tables, read and written. Paths are whatever Spark's file systems take, compressed files too."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import Key, OrderedFrame, keys
from ..store import stored


def read_lines(spark: SparkSession, *paths: str) -> OrderedFrame:
    """One row a line, ordered by file name, split and place in the split. Missing paths raise."""
    text = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return OrderedFrame(text, (Key("file"), Key("block"), Key("place")))


def write_lines(df: DataFrame, path: str, column: str, rows_per_file: int = 0, compression: str = "none") -> None:
    """A folder of text files, one line a row; rows_per_file starts new files."""
    df.select(F.col(column).cast("string")).write.option("maxRecordsPerFile", rows_per_file).option("compression", compression).text(path)


def write_lines_one(frame: OrderedFrame, path: str, column: str) -> None:
    """A folder with one text file, in order: sorted by all tasks, and written by all of them, each at its offset.

    Offsets are sums of the sizes before, one row a task. A repeated task writes the same bytes to the same place. Stores
    that can't write at an offset get their one file from one task.
    """
    spark = frame.df.sparkSession
    line = F.coalesce(F.col(column).cast("string"), F.lit(""))
    folder = shared_folder(spark, path)
    if folder is None:
        frame.sorted().select(line.alias("value")).coalesce(1).write.text(path)
        return
    rows = stored(frame.sorted().select(line.alias("line"), F.monotonically_increasing_id().alias("place")), "lines").withColumn("part", F.shiftright("place", 33))
    sizes = rows.groupBy("part").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    os.makedirs(folder, exist_ok=False)
    at = f"{folder}/part-00000.txt"
    with open(at, "wb") as f:
        f.truncate(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = 0, None
        with open(at, "r+b") as f:
            for batch in batches:
                parts, starts, lines = (batch.column(i).to_pylist() for i in range(3))
                for part, start, text in zip(parts, starts, lines):
                    if part != last:
                        f.seek(start)
                        last = part
                    f.write(text.encode() + b"\n")
                n += batch.num_rows
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    placed = rows.join(before, "part").repartition("part").sortWithinPartitions("part", "place")
    placed.select("part", "start", "line").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The path in a file system of the operating system (which all executors mount), or None for other stores."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(conf).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_binary(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_binary(spark: SparkSession, path: str, *order: str) -> OrderedFrame:
    return OrderedFrame(spark.read.parquet(path), keys(order))


def write_records(df: DataFrame, path: str, column: str, width: int, pattern: str = "records-@@@@-####.bin", file_bytes: int = 1 << 27) -> DataFrame:
    """Fixed-width binary records, in the order of the frame's partitions: (file, size), stored.

    A task writes files of at most ``file_bytes`` (one record at least), named by its number and the file's. A value of
    another width raises. A file appears whole or not at all, and a repeated task writes the same names.
    """
    schema = "file string, size bigint"
    most = max(1, file_bytes // width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        if path.startswith("file:") or "://" not in path:
            store, root = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        done: list = []
        held: list[bytes] = []
        count = 0

        def flush():
            nonlocal count
            name = file_pattern(pattern, task, len(done))
            temp = f"{root}/.{name}.{attempt}"
            with store.open_output_stream(temp) as sink:
                for part in held:
                    sink.write(part)
            store.move(temp, f"{root}/{name}")
            done.append((name, count * width))
            held.clear()
            count = 0

        for batch in batches:
            values = batch.column(0)
            if values.null_count or not all(len(v) == width for v in values.to_pylist()):
                raise ValueError(f"records of {width} bytes were expected")
            flat, at = values.cast(pa.binary(width)), 0
            while at < len(flat):
                part = flat.slice(at, most - count)
                held.append(b"".join(part.to_pylist()))
                at, count = at + len(part), count + len(part)
                if count == most:
                    flush()
        if count:
            flush()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["file", "size"])

    return stored(df.select(column).mapInArrow(write, schema), "record-files")


def read_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(record binary) of files of fixed-width records, split into ranges of whole records that tasks read on their own.

    A file whose size is not a multiple of ``width`` raises; sizes come from the listing, without reading files.
    """
    odd = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") % width != 0).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].path}: {odd[0].length} bytes are no multiple of {width}")
    sc = spark.sparkContext
    found = sc._jsc.sc().binaryRecords(path, width, sc._jsc.hadoopConfiguration())
    frame = spark._jsparkSession.createDataset(found, sc._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(frame.toDF(), spark).toDF("record")


def file_pattern(pattern: str, task: int, chunk: int) -> str:
    """The last run of @ is the task's number, the last run of # the chunk's; without them 4 and 10 digits are added before the extension."""
    stem, dot, extension = pattern.rpartition(".") if "." in pattern.rsplit("/", 1)[-1] else (pattern, "", "")
    for mark, value, width in (("@", task, 4), ("#", chunk, 10)):
        found = list(re.finditer(f"{mark}+", stem))
        if found:
            a, b = found[-1].span()
            stem = stem[:a] + str(value).zfill(b - a) + stem[b:]
        else:
            stem += str(value).zfill(width)
    return stem + dot + extension
