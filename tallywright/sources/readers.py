"""Sources: declared schemas, no inference; matrices through a Python data source; plug-in decoders for payloads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallywright.schema import require_rows


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """Whole JSON documents, or one a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def vocabulary(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """A one-column file with a header as idx, code: idx is the line's place in the file, from 0.

    The file is read whole as one text, so that places are those of the file; it is a dimension, small by nature.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")))
    out = lines.filter("pos > 0").select((F.col("pos") - 1).alias("idx"), F.lower(F.trim("col")).alias("code"))
    return require_rows(out, size, path) if size is not None else out


def listed(spark: SparkSession, folder: str, pattern: str = "*.ogg") -> DataFrame:
    """The files of a folder: path, filename."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))


def unlabelled(files: DataFrame, labelled: DataFrame) -> DataFrame:
    return files.join(labelled.select("filename"), "filename", "left_anti")


def optional(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The union of the Parquet folders that exist, or None. Existence is asked of the path's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    return spark.read.parquet(*there) if there else None


def cells(spark: SparkSession, folder: str, expected: int, schema: str) -> DataFrame:
    """The result cells of a folder, in their order; refuses an incomplete set."""
    return require_rows(json(spark, f"{folder}/*.json", schema), expected, folder).orderBy("ord")


@dataclass
class Written(WriterCommitMessage):
    """Shards that a task wrote: the names they have and those they get."""

    files: list[tuple[str, str]]


class RowRange(InputPartition):
    """Rows of a file, to its last without an end; its first row has the id `first`."""

    def __init__(self, path: str, first: int, start: int, end: int | None):
        super().__init__((path, start, end))
        self.path, self.first, self.start, self.end = path, first, start, end


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """shape, whether columns lie together, type and the first byte of an open .npy file's matrix."""
    version = np.lib.format.read_magic(file)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"a .npy file of version {version} can't be read")
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(file)
    if len(shape) != 2 or kind.hasobject:
        raise ValueError(f"a matrix of numbers is wanted, not {kind} of shape {shape}")
    return shape, by_column, kind, file.tell()


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", "8"))
        self.classes = [int(c) for c in options["classes"].split(",")] if options.get("classes") else None

    def partitions(self) -> list[InputPartition]:
        system, path = store(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            names = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("row_") and f.base_name.endswith(".npy")]
            return [RowRange(n, int(n.rsplit("row_", 1)[1].removesuffix(".npy")), 0, None) for n in sorted(names)] or [RowRange(path, 0, 0, 0)]
        with system.open_input_file(path) as file:
            rows = header(file)[0][0]
        step = max(1, -(-rows // self.parts))
        return [RowRange(path, 0, a, min(rows, a + step)) for a in range(0, rows, step)] or [RowRange(path, 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        system, _ = store(self.path)
        with system.open_input_file(partition.path) as file:
            (rows, width), by_column, kind, base = header(file)
            wanted = np.arange(width) if self.classes is None else np.array([c for c in sorted(set(self.classes)) if 0 <= c < width], np.int64)

            def part(first: int, count: int) -> np.ndarray:
                content = file.read_at(count * kind.itemsize, base + first * kind.itemsize)
                if len(content) != count * kind.itemsize:
                    raise EOFError(f"{partition.path} ends before its last row")
                return np.frombuffer(content, kind)

            end = rows if partition.end is None else partition.end
            for a in range(partition.start, end, 4096):
                n = min(end - a, 4096)
                if by_column:  # the bytes of other classes are not read
                    block = np.column_stack([part(int(c) * rows + a, n) for c in wanted]) if len(wanted) else np.zeros((n, 0))
                else:
                    block = part(a * width, n * width).reshape(n, width)[:, wanted]
                row = np.repeat(np.arange(a, a + n) + partition.first, len(wanted))
                yield pa.RecordBatch.from_pydict({"row_id": pa.array(row, pa.int64()), "class_id": pa.array(np.tile(wanted, n), pa.int32()), "score": pa.array(block.astype(np.float64).ravel(), from_pandas=True)})


class MatrixWriter(DataSourceArrowWriter):
    """Executors write shards into a folder of their own; the driver moves those of the attempts that count into place.

    Rows come by lot and row. A shard is one lot's matrix in a task's memory.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.classes, self.rows = options["path"].rstrip("/"), int(options["classes"]), int(options["rows"])
        self.part, self.overwrite = f"{self.path}/_part-{uuid.uuid4().hex}", overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = store(self.part)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        lot, matrix, size = None, None, 0

        def close() -> None:
            name, attempt = f"row_{lot * self.rows:012d}.npy", uuid.uuid4().hex
            with system.open_output_stream(f"{folder}/{attempt}") as out:
                whole = np.ascontiguousarray(matrix[:size])
                np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(whole))
                out.write(memoryview(whole).cast("B") if whole.size else b"")
            files.append((attempt, name))

        for batch in iterator:
            row, column, score = (batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "class_id", "score"))
            row, column, score = row.to_numpy(), column.to_numpy(), score.to_numpy(zero_copy_only=False).astype(float)
            for each in np.unique(row // self.rows):
                own = row // self.rows == each
                if each != lot:
                    if lot is not None:
                        close()
                    lot, matrix, size = int(each), np.full((self.rows, self.classes), np.nan), 0
                at = row[own] - lot * self.rows
                matrix[at, column[own]] = score[own]
                size = max(size, int(at.max()) + 1)
        if lot is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = store(self.path)
        _, part = store(self.part)
        moved = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            kept = {name for _, name in moved}
            for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.base_name.startswith("row_") and old.base_name not in kept:
                    system.delete_file(old.path)
        for attempt, name in moved:
            system.move(f"{part}/{attempt}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, part = store(self.part)
        system.delete_dir_contents(part, missing_dir_ok=True)
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_dir(part)


class MatrixSource(DataSource):
    """Dense .npy matrices in long form; NaN is NULL.

    Read: a file on any store that Arrow opens, by ranges of rows, or a folder of shards; with classes, only those. Write:
    shards of so many rows by the executors. Path, classes and rows are options.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_id bigint, class_id int, score double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MatrixReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MatrixWriter(self.options, overwrite)


def matrix(spark: SparkSession, path: str, partitions: int = 8, classes: list[int] | None = None) -> DataFrame:
    """A 2-D .npy file, or a folder of shards row_<first row>.npy, in long form, of the given classes or all.

    Of a file whose columns lie together only the classes' bytes are read; of others their rows, 4096 at a time.
    """
    if classes is not None and not classes:
        raise ValueError("name at least one class")
    spark.dataSource.register(MatrixSource)
    source = spark.read.format("npy").option("path", path).option("partitions", str(partitions))
    return (source if classes is None else source.option("classes", ",".join(map(str, classes)))).load()


def matrices(spark: SparkSession, folder: str) -> DataFrame:
    """The .npy shards of a folder, row_<first row>.npy, in long form, read through Spark's own files: any store will do.

    A shard is read by one task, so shards should have some megabytes; sinks.write_npy makes such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                first = int(path.rsplit("row_", 1)[1].removesuffix(".npy"))
                whole = np.load(BytesIO(content), allow_pickle=False)
                for a in range(0, len(whole), 4096):
                    block = whole[a : a + 4096].astype(np.float64)
                    row, column = (x.ravel() for x in np.indices(block.shape))
                    yield pa.RecordBatch.from_pydict({"row_id": pa.array(row + first + a, pa.int64()), "class_id": pa.array(column, pa.int32()), "score": pa.array(block.ravel(), from_pandas=True)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "row_*.npy").load(folder)
    return files.select("path", "content").mapInArrow(run, "row_id bigint, class_id int, score double")


def centred(samples, length: int):
    """The middle window of an array of samples, zeros at the end where it is short."""
    size = F.size(samples)
    start = F.greatest(F.lit(0), F.floor((size - length) / 2)).cast("int")
    part = F.slice(samples, start + 1, length)
    return F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), length - F.size(part))))


def window_at(samples, start_sec, rate: int, length: int):
    """The window that begins at start_sec, zeros at the end where it is short."""
    part = F.slice(samples, (start_sec * rate + 1).cast("int"), length)
    return F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), length - F.size(part))))


def decoded(files: DataFrame, decoder: Callable[[bytes], np.ndarray]) -> DataFrame:
    """path, samples of binary files by a plug-in decoder; a payload that can't be decoded gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    out.append(np.asarray(decoder(content), np.float32))
                except ValueError:
                    out.append(np.zeros(0, np.float32))
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "samples": pa.array(out, pa.list_(pa.float32()))})

    return files.select("path", "content").mapInArrow(run, "path string, samples array<float>")
