"""Array files as DataFrames: .npy and .npz through Spark's own binary reader, and chunked array stores.

Whole files are opened by Spark only, so any store that the cluster can read will do. Slices of files too large for that
are read by ranges of bytes through Arrow's file systems (local and shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_BATCH = 4096


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def _small_file(spark: SparkSession, path: str) -> str:
    """A text file by the store's own client, as Spark's readers pass over names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def npy_header(data: bytes) -> tuple[tuple[int, ...], np.dtype, bool]:
    """Shape, type and order from the first bytes of an .npy file."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    return shape, dtype, fortran


def read_npy(spark: SparkSession, path: str, member: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(file, i, vals): the array's first axis as rows, the others flattened in C order to doubles.

    member reads one array of .npz archives. Files over most_bytes are refused. Fortran order is refused as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, data in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("content").to_pylist(), strict=True):
                if most_bytes is not None and size > most_bytes:
                    raise ValueError(f"{name} has {size} bytes; at most {most_bytes} are read")
                x = np.load(io.BytesIO(data), allow_pickle=False)
                x = x[member] if member else x
                if x.ndim > 1 and not x.flags.c_contiguous:
                    raise ValueError(f"{name} isn't in C order")
                x = x.reshape(len(x), -1).astype(np.float64)
                for a in range(0, len(x), ROWS_A_BATCH):
                    part = x[a : a + ROWS_A_BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["file", "i", "vals"])

    return _binary(spark, path).mapInArrow(run, "file string, i long, vals array<double>")


def member_offset(file, member: str) -> int:
    """Where the bytes of an uncompressed member begin in a zip archive that is open for reading."""
    with zipfile.ZipFile(file) as archive:
        info = archive.getinfo(member)
    if info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"{member} is compressed; only whole archives of such members can be read")
    file.seek(info.header_offset)
    local = file.read(30)
    return info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")


def _open(uri: str):
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def slice_npy(spark: SparkSession, uri: str, start: int = 0, stop: int | None = None, member: str | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """(i, vals): rows start to stop of an .npy file's first axis, or of an uncompressed member of an .npz archive.

    Only the header is read on the driver. Each task reads ranges of at most task_bytes (one row at least), so a file may
    be of any size, and nothing outside the slice is touched. Floats keep their width; other types become doubles.
    """
    with _open(uri) as f:
        at = 0
        if member:
            at = member_offset(f, member if member.endswith(".npy") else f"{member}.npy")
        f.seek(at)
        first = f.read(12)
        size = 10 + int.from_bytes(first[8:10], "little") if first[6] == 1 else 12 + int.from_bytes(first[8:12], "little")
        f.seek(at)
        shape, dtype, fortran = npy_header(f.read(size))
    if fortran and len(shape) > 1:
        raise ValueError(f"{uri} isn't in C order")
    if not shape:
        raise ValueError(f"{uri} holds a single value")
    stop = shape[0] if stop is None else min(stop, shape[0])
    width = int(np.prod(shape[1:]))
    row, begin = width * dtype.itemsize, at + size
    rows = max(1, task_bytes // max(1, row))
    kind, arrow = ("float", pa.float32()) if dtype.kind == "f" and dtype.itemsize == 4 else ("double", pa.float64())
    parts = max(0, -(-(stop - start) // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                lo = start + part * rows
                hi = min(stop, lo + rows)
                with _open(uri) as f:
                    f.seek(begin + lo * row)
                    x = np.frombuffer(f.read((hi - lo) * row), dtype).reshape(hi - lo, width).astype(arrow.to_pandas_dtype())
                offsets = pa.array(np.arange(0, (hi - lo) * width + 1, width), pa.int32()) if width else pa.array([0] * (hi - lo + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), arrow))], ["i", "vals"])

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, f"i long, vals array<{kind}>")


def unpacked_chunk(compressor: str | None, data: bytes) -> bytes:
    if compressor is None:
        return data
    if compressor == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zlib.decompress(data, 47)  # zlib or gzip


def read_chunked(spark: SparkSession, path: str, array: str) -> DataFrame:
    """(i, vals) of a chunked store's array, its first axis as rows and the others flattened in C order to doubles.

    The metadata (.zarray) is read on the driver; each chunk is one task's file. Chunks may be cut along any axis, raw or
    packed by zlib, gzip or zstd; missing chunks are the fill value.
    """
    meta = json.loads(_small_file(spark, f"{path}/{array}/.zarray"))
    shape, chunks, order = meta["shape"], meta["chunks"], meta.get("order", "C")
    if order != "C":
        raise ValueError("chunks must be in C order")
    compressor = (meta.get("compressor") or {}).get("id")
    if compressor not in (None, "zlib", "gzip", "zstd") or meta.get("filters"):
        raise ValueError(f"chunks compressed by {compressor} can't be read")
    dtype, n, step, rest = np.dtype(meta["dtype"]), shape[0], chunks[0], tuple(shape[1:])
    fill_value = float(meta.get("fill_value") or 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = name.rstrip("/")
                place = [int(v) for v in re.split(r"[./]", re.search(r"[0-9]+(?:[./][0-9]+)*$", name)[0])[-len(shape) :]]
                begin = [k * c for k, c in zip(place, chunks, strict=True)]
                held = tuple(slice(0, min(c, s - a)) for a, c, s in zip(begin, chunks, shape, strict=True))
                x = np.frombuffer(unpacked_chunk(compressor, data), dtype).reshape(chunks)[held].astype(np.float64)
                rows = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin[0], begin[0] + rows), pa.int64()), pa.array([begin[1:]] * rows, pa.list_(pa.int32())), pa.array([list(x.shape[1:])] * rows, pa.list_(pa.int32())), pa.array(list(x.reshape(rows, -1)), pa.list_(pa.float64()))], ["i", "at", "size", "vals"])

    def whole(table: pa.Table) -> pa.Table:
        out = np.full(rest, fill_value)
        for at, size, vals in zip(*(table.column(c).to_pylist() for c in ("at", "size", "vals")), strict=True):
            out[tuple(slice(a, a + s) for a, s in zip(at, size, strict=True))] = np.reshape(vals, size)
        return pa.table([table.column("i").slice(0, 1).combine_chunks(), pa.array([out.ravel()], pa.list_(pa.float64()))], ["i", "vals"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").option("recursiveFileLookup", "true").load(f"{path}/{array}")
    found = files.select("path", "content").mapInArrow(run, "i long, at array<int>, size array<int>, vals array<double>")
    if list(rest) == chunks[1:]:
        found = found.select("i", "vals")
    else:  # a row's parts meet by its number
        found = found.groupBy("i").applyInArrow(whole, "i long, vals array<double>")
    fill = F.array_repeat(F.lit(fill_value), int(np.prod(rest)))
    return spark.range(n).select(F.col("id").alias("i")).join(found, "i", "left").withColumn("vals", F.coalesce("vals", fill))


def require_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    """df with exactly the wanted columns, if names and types agree; nothing is inferred or cast."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType}" for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*[f.name for f in want])
