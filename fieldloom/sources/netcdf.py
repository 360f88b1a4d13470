"""NetCDF classic files (CDF-1, CDF-2, CDF-5): headers, ranges of records, decoded times, and a writer.

A header says where every value lies, so a task reads only the bytes of its records. Files of the HDF5-based format are
refused by name. All numbers are big-endian, as the format asks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_output, open_uri

# Fixed values of the format: tags of lists, and codes of types.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_CODES = {np.dtype(t): c for c, t in TYPES.items()}
#: Bytes of a header that are read at once; more are read if it is longer.
HEADER_BYTES = 1 << 16
#: Cumulated days before each month, and days of a year, by calendar.
_MONTHS = {"noleap": [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], "360_day": [30 * k for k in range(12)]}
_YEAR = {"noleap": 365, "360_day": 360}
_CALENDARS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic", "noleap": "noleap", "365_day": "noleap", "360_day": "360_day"}
_UNITS = {"day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0, "hr": 3600.0, "h": 3600.0, "min": 60.0, "sec": 1.0, "s": 1.0, "d": 86400.0}


def _padded(n: int) -> int:
    return -(-n // 4) * 4


@dataclass
class Variable:
    name: str
    dims: list[str]
    attributes: dict
    dtype: np.dtype
    begin: int
    shape: tuple[int, ...]
    record: bool  # whether the first axis is the file's record dimension


@dataclass
class Header:
    version: int
    records: int
    dims: dict[str, int]  # the record dimension has 0
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    stride: int = 0  # bytes from one record to the next

    def variable(self, name: str) -> Variable:
        if name not in self.variables:
            raise ValueError(f"no variable {name}: there are {sorted(self.variables)}")
        return self.variables[name]


class _Reader:
    """Numbers and names from a file, as its version writes them."""

    def __init__(self, f: BinaryIO):
        self.f = f
        magic = self.take(4)
        if magic == b"\x89HDF":
            raise ValueError("an HDF5-based NetCDF-4 file: only the classic formats (CDF-1, CDF-2, CDF-5) are read")
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.version = magic[3]

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) < n:
            raise ValueError("the file ends within its header")
        return data

    def int4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">Q", self.take(8))[0] if self.version == 5 else self.int4()

    def offset(self) -> int:
        return self.int4() if self.version == 1 else struct.unpack(">Q", self.take(8))[0]

    def name(self) -> str:
        n = self.count()
        return self.take(_padded(n))[:n].decode()

    def items(self, tag: int) -> range:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"a list with tag {found} where {tag} belongs")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(_ATTRIBUTES):
            name, code, n = self.name(), self.int4(), self.count()
            dtype = np.dtype(TYPES[code])
            data = self.take(_padded(n * dtype.itemsize))[: n * dtype.itemsize]
            values = data.decode("utf-8", "replace") if code == 2 else np.frombuffer(data, dtype).tolist()
            out[name] = values if code == 2 or n != 1 else values[0]
        return out


def read_header(f: BinaryIO, size: int | None = None) -> Header:
    """The header of an open file. size, the file's bytes, settles the number of records where the file leaves it open."""
    r = _Reader(f)
    records = r.count()
    dims = [(r.name(), r.count()) for _ in r.items(_DIMENSIONS)]
    h = Header(r.version, records, dict(dims), r.attributes())
    sizes = []
    for _ in r.items(_VARIABLES):
        name = r.name()
        ids = [r.count() for _ in range(r.count())]
        attributes, dtype = r.attributes(), np.dtype(TYPES[r.int4()])
        r.count()
        begin, shape = r.offset(), tuple(dims[i][1] for i in ids)
        record = bool(ids) and shape[0] == 0
        h.variables[name] = Variable(name, [dims[i][0] for i in ids], attributes, dtype, begin, shape, record)
        if record:
            sizes.append((int(np.prod(shape[1:])) * dtype.itemsize, dtype))
    h.stride = sizes[0][0] if len(sizes) == 1 else sum(_padded(n) for n, _ in sizes)
    if records in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
        first = min((v.begin for v in h.variables.values() if v.record), default=0)
        h.records = (size - first) // h.stride if size and h.stride else 0
    for v in h.variables.values():
        if v.record:
            v.shape = (h.records, *v.shape[1:])
    return h


def read_rows(f: BinaryIO, h: Header, name: str, lo: int, hi: int) -> np.ndarray:
    """Places lo to hi of a variable's first axis, as they are stored. Only their bytes are read."""
    v = h.variable(name)
    row = int(np.prod(v.shape[1:])) * v.dtype.itemsize
    if v.record and h.stride != row:
        parts = []
        for k in range(lo, hi):
            f.seek(v.begin + k * h.stride)
            parts.append(f.read(row))
        data = b"".join(parts)
    else:
        f.seek(v.begin + lo * row)
        data = f.read((hi - lo) * row)
    return np.frombuffer(data, v.dtype).reshape(hi - lo, *v.shape[1:])


def unpacked(x: np.ndarray, attributes: dict) -> np.ndarray:
    """Values with NaN where they are fill or missing values, scaled and shifted. Floats without a scale keep their width."""
    holes = [attributes[k] for k in ("_FillValue", "missing_value") if isinstance(attributes.get(k), (int, float))]
    scaled = "scale_factor" in attributes or "add_offset" in attributes
    out = x.astype(np.float32 if x.dtype.kind == "f" and x.dtype.itemsize == 4 and not scaled else np.float64)
    if scaled:
        out = out * attributes.get("scale_factor", 1.0) + attributes.get("add_offset", 0.0)
    for value in holes:
        out[x == np.array(value).astype(x.dtype)] = np.nan
    return out


def _day_number(year: int, month: int, day: int, calendar: str) -> int:
    if calendar in _MONTHS:
        return year * _YEAR[calendar] + _MONTHS[calendar][month - 1] + day - 1
    return int(np.datetime64(f"{year:04d}-{month:02d}-{day:02d}", "D").astype(np.int64))


def decoded_dates(values: np.ndarray, units: str, calendar: str = "standard") -> list[str]:
    """YYYY-MM-DD of times like "days since 1990-01-01 12:00". The standard calendar is that of dates after 1582-10-15;
    earlier ones are refused."""
    unit, since, start = units.partition(" since ")
    seconds = _UNITS.get(unit.strip().lower()) or _UNITS.get(unit.strip().lower().removesuffix("s"))
    kind = _CALENDARS.get(calendar.lower())
    if not since or not seconds or not kind:
        raise ValueError(f"times in {units!r} of the calendar {calendar!r} can't be decoded")
    date, _, clock = start.strip().replace("T", " ").partition(" ")
    clock = clock.split("+")[0].strip().rstrip("Z").removesuffix("UTC").strip() or "0"
    parts = [float(p) for p in clock.split(":")] + [0.0, 0.0]
    year, month, day = (int(p) for p in date.split("-"))
    first = _day_number(year, month, day, kind)
    days = first + np.floor((np.asarray(values, np.float64) * seconds + parts[0] * 3600 + parts[1] * 60 + parts[2] + 1e-6) / 86400.0).astype(np.int64)
    if kind in _MONTHS:
        years, left = np.divmod(days, _YEAR[kind])
        months = np.searchsorted(_MONTHS[kind], left, "right")
        return [f"{y:04d}-{m:02d}-{d - _MONTHS[kind][m - 1] + 1:02d}" for y, m, d in zip(years.tolist(), months.tolist(), left.tolist(), strict=True)]
    if kind == "standard" and min(first, days.min(initial=first)) < np.datetime64("1582-10-15").astype(np.int64):
        raise ValueError("dates before 1582-10-15 of the standard calendar aren't decoded")
    return np.datetime_as_string(days.astype("datetime64[D]")).tolist()


def _name(text: str, wide: bool) -> bytes:
    data = text.encode()
    return _count(len(data), wide) + data.ljust(_padded(len(data)), b"\0")


def _count(n: int, wide: bool) -> bytes:
    return struct.pack(">Q" if wide else ">I", n)


def _attribute_list(attributes: dict, wide: bool) -> bytes:
    if not attributes:
        return struct.pack(">I", 0) + _count(0, wide)
    out = [struct.pack(">I", _ATTRIBUTES) + _count(len(attributes), wide)]
    for name, value in attributes.items():
        if isinstance(value, str):
            code, data, n = 2, value.encode(), len(value.encode())
        else:
            x = np.atleast_1d(np.asarray(value))
            x = x.astype(">f8" if x.dtype.kind == "f" and x.dtype.itemsize == 8 else ">f4" if x.dtype.kind == "f" else ">i4")
            code, data, n = _CODES[x.dtype], x.tobytes(), len(x)
        out.append(_name(name, wide) + struct.pack(">I", code) + _count(n, wide) + data.ljust(_padded(len(data)), b"\0"))
    return b"".join(out)


def file_bytes(record: str, dims: dict[str, int], fixed: dict, records: dict, attributes: dict | None = None, version: int = 2) -> bytes:
    """A whole file: fixed and records map a name to (dims, array, attributes); records' arrays begin with the record axis."""
    wide, offset = version == 5, ">I" if version == 1 else ">Q"
    order = {record: 0, **dims}
    ids, n = {d: k for k, d in enumerate(order)}, max((len(x) for _, x, _ in records.values()), default=0)
    head = b"CDF" + bytes([version]) + _count(n, wide) + struct.pack(">I", _DIMENSIONS) + _count(len(order), wide)
    head += b"".join(_name(d, wide) + _count(k, wide) for d, k in order.items()) + _attribute_list(attributes or {}, wide)
    entries = []
    for name, (names, x, own) in [*fixed.items(), *((k, ([record, *d], x, a)) for k, (d, x, a) in records.items())]:
        x = np.asarray(x)
        x = x.astype(x.dtype.newbyteorder(">")) if x.dtype.itemsize > 1 else x
        row = x.itemsize * int(np.prod(x.shape[1:] if name in records else x.shape))
        entry = _name(name, wide) + _count(len(names), wide) + b"".join(_count(ids[d], wide) for d in names) + _attribute_list(own, wide) + struct.pack(">I", _CODES[x.dtype]) + _count(min(_padded(row), 0xFFFFFFFF), wide)
        entries.append((entry, x, row, name in records))
    lists = struct.pack(">I", _VARIABLES) + _count(len(entries), wide)
    at = len(head) + len(lists) + sum(len(e) + struct.calcsize(offset) for e, *_ in entries)
    body, written = [], []
    for entry, x, row, is_record in entries:
        written.append(entry + struct.pack(offset, at))
        at += row if is_record and len(records) == 1 else _padded(row)
        if not is_record:
            body.append(x.tobytes().ljust(_padded(row), b"\0"))
    turns = [(x, row, row if len(records) == 1 else _padded(row)) for _, x, row, is_record in entries if is_record]
    body += [x[k : k + 1].tobytes().ljust(size, b"\0") for k in range(n) for x, _, size in turns]
    return head + lists + b"".join(written) + b"".join(body)


def write_netcdf(df: DataFrame, folder: str, dims: dict[str, int], variable: str = "value", records_per_file: int = 31, start: str = "1970-01-01", attributes: dict | None = None, version: int = 2) -> list[str]:
    """df(day, vals), day counting days from start, as one file for each run of so many days, in any folder Arrow can write.

    A task holds one file's fields. Each file is whole or absent under its name, and a repeated task writes the same bytes.
    Returns the files' names in order of days. Days that are there twice are refused.
    """
    shape, own = tuple(dims.values()), dict(attributes or {})
    wide = dict(df.dtypes)["vals"] == "array<double>"

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        day = table.column("day").to_numpy()
        if len(np.unique(day)) < len(day):
            raise ValueError("a day that is there twice")
        x = table.column("vals").combine_chunks().flatten().to_numpy().astype(">f8" if wide else ">f4").reshape(len(day), *shape)
        time = ([], day.astype(">f8"), {"units": f"days since {start}", "calendar": "proleptic_gregorian"})
        name = f"{variable}-{int(day[0]) // records_per_file * records_per_file:08d}.nc"
        with open_output(f"{folder}/{name}") as f:
            f.write(file_bytes("time", dims, {}, {"time": time, variable: (list(dims), x, own)}, {"Conventions": "CF-1.8"}, version))
        return pa.table([pa.array([name]), pa.array([len(day)], pa.int64())], ["name", "days"])

    files = df.select("day", "vals").groupBy(F.floor(F.col("day") / records_per_file)).applyInArrow(save, "name string, days long")
    return [f"{folder}/{r.name}" for r in files.orderBy("name").collect()]


def header_of(uri: str) -> Header:
    with open_uri(uri) as f:
        return read_header(f, f.size())


def times_of(uri: str, h: Header, name: str = "time") -> list[str]:
    """The decoded dates of a file's time variable."""
    v = h.variable(name)
    with open_uri(uri) as f:
        values = read_rows(f, h, name, 0, v.shape[0])
    return decoded_dates(values, str(v.attributes.get("units", "")), str(v.attributes.get("calendar", "standard")))


def iterate_rows(uri: str, h: Header, name: str, lo: int, hi: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first, values) of runs of at most step places, unpacked."""
    with open_uri(uri) as f:
        for a in range(lo, hi, step):
            yield a, unpacked(read_rows(f, h, name, a, min(hi, a + step)), h.variable(name).attributes)
