"""A Spark data source of field stores: ordered segments, each a chunked store, an .npy file or a NetCDF classic file.

A store's metadata is read and checked when the query is planned. Its partitions are the chunks of the days that are asked
for, by place or date, so nothing else of the data is opened. A partition reads all inner chunks of its days and hands
them on as Arrow buffers; no shuffle joins the parts of a field.

The days are arguments of the read. Spark 4.1 can push filters into Python sources, but keeps them with the table: two
filters on one DataFrame in one query (a union, say) would both read the days of the last one.
"""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import netcdf
from .arrays import npy_header, unpacked_chunk
from .files import open_output, open_uri, read_bytes

#: Bytes of fields that a partition holds, one chunk of days at least.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Array:
    """One array of a segment: where it lies, and what it takes to read days of it."""

    kind: str  # chunks, npy or netcdf
    uri: str
    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    step: int  # days that lie together
    detail: tuple = ()

    @property
    def row(self) -> tuple[int, ...]:
        return self.shape[1:]

    @property
    def single(self) -> bool:
        return self.dtype.kind == "f" and self.dtype.itemsize == 4

    @classmethod
    def chunked(cls, store: str, name: str) -> Array:
        data = read_bytes(f"{store}/{name}/.zarray")
        if data is None:
            raise ValueError(f"{store} has no array {name}")
        meta = json.loads(data)
        compressor = (meta.get("compressor") or {}).get("id")
        if meta.get("order", "C") != "C" or meta.get("filters") or compressor not in (None, "zlib", "gzip", "zstd"):
            raise ValueError(f"{store}/{name}: chunks in order {meta.get('order')} packed by {compressor} with filters {meta.get('filters')} can't be read")
        detail = (tuple(meta["chunks"]), compressor, float(meta.get("fill_value") or 0.0), meta.get("dimension_separator", "."))
        return cls("chunks", f"{store}/{name}", name, tuple(meta["shape"]), np.dtype(meta["dtype"]), meta["chunks"][0], detail)

    @classmethod
    def npy(cls, uri: str, name: str) -> Array:
        with open_uri(uri) as f:
            first = f.read(12)
            size = 10 + int.from_bytes(first[8:10], "little") if first[6] == 1 else 12 + int.from_bytes(first[8:12], "little")
            f.seek(0)
            shape, dtype, fortran = npy_header(f.read(size))
        if not shape or fortran and len(shape) > 1:
            raise ValueError(f"{uri} isn't an array of days in C order")
        return cls("npy", uri, name, shape, dtype, 1, (size,))

    @classmethod
    def netcdf(cls, uri: str, name: str) -> Array:
        h = netcdf.header_of(uri)
        v = h.variable(name)
        scaled = {"scale_factor", "add_offset"} & set(v.attributes) or v.dtype.kind != "f"
        return cls("netcdf", uri, name, v.shape, np.dtype("f8") if scaled else v.dtype, 1)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Days lo to hi, flattened, as floats of the array's width."""
        out = np.float32 if self.single else np.float64
        width = math.prod(self.row)
        if self.kind == "chunks":
            return self._chunks(lo, hi).reshape(hi - lo, width).astype(out, copy=False)
        with open_uri(self.uri) as f:
            if self.kind == "npy":
                bytes_ = width * self.dtype.itemsize
                f.seek(self.detail[0] + lo * bytes_)
                return np.frombuffer(f.read((hi - lo) * bytes_), self.dtype).reshape(hi - lo, width).astype(out)
            h = netcdf.read_header(f, f.size())
            return netcdf.unpacked(netcdf.read_rows(f, h, self.name, lo, hi), h.variable(self.name).attributes).reshape(hi - lo, width)

    def _chunks(self, lo: int, hi: int) -> np.ndarray:
        chunks, compressor, fill, dot = self.detail
        out = np.full((hi - lo, *self.row), fill, self.dtype)
        spans = [range(lo // chunks[0], -(-hi // chunks[0])), *(range(-(-n // c)) for n, c in zip(self.row, chunks[1:], strict=True))]
        for place in itertools.product(*spans):
            data = read_bytes(f"{self.uri}/{dot.join(map(str, place))}")
            if data is None:
                continue  # a chunk that isn't there is the fill value
            x = np.frombuffer(unpacked_chunk(compressor, data), self.dtype).reshape(chunks)
            begin = [k * c for k, c in zip(place, chunks, strict=True)]
            a, b = max(lo, begin[0]), min(hi, begin[0] + chunks[0])
            inner = [slice(s, min(s + c, n)) for s, c, n in zip(begin[1:], chunks[1:], self.row, strict=True)]
            out[(slice(a - lo, b - lo), *inner)] = x[(slice(a - begin[0], b - begin[0]), *(slice(0, s.stop - s.start) for s in inner))]
        return out


@dataclass
class Segment:
    """Arrays over the same days, after the days of the segments before."""

    uri: str
    arrays: list[Array]
    offset: int
    days: int
    dates: str = ""

    def date_labels(self, lo: int, hi: int) -> list[str] | None:
        """The dates of days lo to hi: from the store's array of dates, or a NetCDF file's decoded times."""
        if not self.dates:
            return None
        if self.arrays[0].kind == "netcdf":
            return netcdf.times_of(self.uri, netcdf.header_of(self.uri), self.dates)[lo:hi]
        found = Array.chunked(self.uri, self.dates)
        if found.shape != (self.days,):
            raise ValueError(f"{self.uri}: {self.dates} has the shape {found.shape} for {self.days} days")
        x = found._chunks(lo, hi)
        text = [v.decode() if isinstance(v, bytes) else str(v) for v in x.tolist()]
        return [f"{t[:4]}-{t[4:6]}-{t[6:]}" if len(t) == 8 and t.isdigit() else t for t in text]


def open_segment(uri: str, names: list[str], offset: int, dates: str, want: dict) -> Segment:
    """A segment whose metadata are as wanted: shape and dtype of arrays, and attributes. Raises ValueError if not."""
    kind = "npy" if uri.endswith(".npy") else "netcdf" if uri.endswith((".nc", ".cdf", ".nc3")) else "chunks"
    arrays = [{"npy": Array.npy, "netcdf": Array.netcdf, "chunks": Array.chunked}[kind](uri, n) for n in names]
    days = {a.shape[0] for a in arrays}
    if len(days) != 1:
        raise ValueError(f"{uri}: arrays of {sorted(days)} days")
    for a in arrays:
        expected = want.get("arrays", {}).get(a.name, {})
        if "shape" in expected and list(a.row) != list(expected["shape"]) or "dtype" in expected and a.dtype.newbyteorder("=") != np.dtype(expected["dtype"]):
            raise ValueError(f"{uri}: {a.name} is {list(a.row)} of {a.dtype}, wanted is {expected}")
    if wanted := want.get("attributes"):
        have = json.loads(read_bytes(f"{uri}/.zattrs") or b"{}") if kind == "chunks" else netcdf.header_of(uri).attributes if kind == "netcdf" else {}
        wrong = {k: have.get(k) for k, v in wanted.items() if have.get(k) != v}
        if wrong:
            raise ValueError(f"{uri}: attributes {wrong}, wanted are {wanted}")
    segment = Segment(uri, arrays, offset, days.pop(), "" if kind == "npy" else dates)
    if segment.dates and kind == "chunks" and Array.chunked(uri, dates).shape != (segment.days,):
        raise ValueError(f"{uri}: {dates} doesn't give one date a day")
    return segment


@dataclass
class Span(InputPartition):
    segment: int
    lo: int
    hi: int


class StoreReader(DataSourceReader):
    """Days first to last (exclusive) by place over all segments, and of them those of some dates if these are named."""

    def __init__(self, segments: list[Segment], task_bytes: int, first: int = 0, last: int | None = None, dates: list[str] | None = None):
        days = sum(s.days for s in segments)
        self.segments, self.task_bytes, self.dates = segments, task_bytes, dates
        self.first, self.last = (days if v is None else v + days if v < 0 else v for v in (first, last))
        if not 0 <= self.first <= self.last <= days:
            raise ValueError(f"days {first} to {last} aren't covered by the {days} days of the segments")

    def _kept(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Days of a segment between lo and hi that are asked for."""
        s = self.segments[k]
        day = np.arange(max(lo, self.first - s.offset), max(lo, min(hi, self.last - s.offset)))
        if self.dates is None or not len(day):
            return day
        labels = s.date_labels(int(day[0]), int(day[-1]) + 1) or [""] * len(day)
        return day[np.isin(labels, self.dates)]

    def partitions(self) -> list[Span]:
        out = []
        for k, s in enumerate(self.segments):
            bytes_ = sum(math.prod(a.row) * a.dtype.itemsize for a in s.arrays)
            step = s.arrays[0].step
            step *= max(1, self.task_bytes // max(1, bytes_ * step))
            days = self._kept(k, 0, s.days)
            out += [Span(k, c * step, min((c + 1) * step, s.days)) for c in np.unique(days // step).tolist()]
        return out or [Span(0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        s = self.segments[span.segment]
        days = self._kept(span.segment, span.lo, span.hi)
        if not len(days):
            return
        # a chunk of days at a time, and of it the days from the first to the last that is kept
        for chunk in np.split(days, np.flatnonzero(np.diff(days // s.arrays[0].step)) + 1):
            lo, hi = int(chunk[0]), int(chunk[-1]) + 1
            labels = s.date_labels(lo, hi)
            columns = [pa.array(np.full(len(chunk), span.segment, np.int32)), pa.array(chunk), pa.array(chunk + s.offset)]
            columns.append(pa.array([labels[d - lo] for d in chunk.tolist()] if labels else [None] * len(chunk), pa.string()))
            for a in s.arrays:
                x = a.read(lo, hi)
                x = x if len(chunk) == len(x) else x[chunk - lo]
                offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]))[: len(x) + 1] if x.shape[1] else np.zeros(len(x) + 1), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["segment", "day", "place", "date", *(a.name for a in s.arrays)])


class FieldStores(DataSource):
    """Options: stores, arrays and wanted (JSON lists), dates (a name), want (JSON), first, last, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fieldstores"

    def _segments(self) -> list[Segment]:
        names, want, out = json.loads(self.options["arrays"]), json.loads(self.options.get("want", "{}")), []
        for uri in json.loads(self.options["stores"]):
            out.append(open_segment(uri.rstrip("/"), names, sum(s.days for s in out), self.options.get("dates", ""), want))
            if [(a.row, a.single) for a in out[-1].arrays] != [(a.row, a.single) for a in out[0].arrays]:
                raise ValueError(f"{uri}: its fields aren't those of the first segment")
        if not out:
            raise ValueError("no stores are named")
        return out

    def schema(self) -> str:
        arrays = self._segments()[0].arrays
        return ", ".join(["segment int, day long, place long, date string", *(f"`{a.name}` array<{'float' if a.single else 'double'}>" for a in arrays)])

    def reader(self, schema) -> StoreReader:
        o = self.options
        return StoreReader(self._segments(), int(o.get("task_bytes", TASK_BYTES)), *(json.loads(o.get(k, d)) for k, d in (("first", "0"), ("last", "null"), ("wanted", "null"))))


def read_stores(
    spark: SparkSession,
    stores: list[str],
    arrays: list[str],
    dates: str = "",
    want: dict | None = None,
    first: int = 0,
    last: int | None = None,
    among: list[str] | None = None,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """segment, day (within it), place (over all), date and the arrays, fields flattened in C order.

    first and last (exclusive) are places; negative ones count from the end, and a range that the segments don't cover is
    refused. dates names the array of dates or times, among the dates (YYYY-MM-DD) that are wanted. want asks for shapes
    and dtypes of arrays and for attributes; a store that has others is refused when the query is planned.
    """
    spark.dataSource.register(FieldStores)
    options = {"stores": stores, "arrays": arrays, "want": want or {}, "first": first, "last": last, "wanted": among}
    return spark.read.format("fieldstores").options(dates=dates, task_bytes=str(task_bytes), **{k: json.dumps(v) for k, v in options.items()}).load()


def write_store(df: DataFrame, store: str, array: str, shape: tuple[int, ...], chunk_days: int = 16, attributes: dict | None = None) -> int:
    """df(day, vals) as a chunked store of so many days a chunk; returns the number of days.

    A task holds one chunk. The array's metadata, and the mark that the store is complete, come last, so a store that a
    failure left is refused by readers that want it complete. Missing days within are the fill value, NaN.
    """
    single, row = dict(df.dtypes)["vals"] == "array<float>", list(shape)
    dtype = np.dtype("<f4" if single else "<f8")

    def save(table: pa.Table) -> pa.Table:
        day = table.column("day").to_numpy()
        chunk = int(day[0]) // chunk_days
        x = np.full((chunk_days, *row), np.nan, dtype)
        x[day - chunk * chunk_days] = table.column("vals").combine_chunks().flatten().to_numpy().reshape(len(day), *row)
        with open_output(f"{store}/{array}/{'.'.join(map(str, [chunk, *([0] * len(row))]))}") as f:
            f.write(zlib.compress(x.tobytes(), 1))
        return pa.table([pa.array([int(day.max()) + 1], pa.int64()), pa.array([len(np.unique(day)) == len(day)])], ["days", "once"])

    chunks = df.select(F.col("day").cast("long").alias("day"), "vals").groupBy(F.floor(F.col("day") / chunk_days)).applyInArrow(save, "days long, once boolean")
    days, once = chunks.agg(F.max("days"), F.bool_and("once")).first()
    if not days or not once:
        raise ValueError("a store needs days, each once")
    meta = {"zarr_format": 2, "shape": [days, *row], "chunks": [chunk_days, *row], "dtype": dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}
    for name, content in ((".zgroup", {"zarr_format": 2}), (f"{array}/.zarray", meta), (".zattrs", {**(attributes or {}), "complete": True})):
        with open_output(f"{store}/{name}") as f:
            f.write(json.dumps(content).encode())
    return days
