"""The data source of field stores and NetCDF files: pruning, validation, segments, round trips, decoded times."""

import datetime
import io
import json
import zlib

import numpy as np
import pytest

from fieldloom.plans import registry
from fieldloom.sources import files, netcdf, stores

from .test_queries import DATA


def store(path, name: str, x: np.ndarray, chunks: tuple, compress: bool = True, dates: bool = True, **attributes):
    folder = path / name
    (folder / "v").mkdir(parents=True)
    for place in np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunks, strict=True))):
        part = np.zeros(chunks, x.dtype)
        cut = x[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks, strict=True))]
        part[tuple(slice(0, n) for n in cut.shape)] = cut
        data = part.tobytes()
        (folder / "v" / ".".join(map(str, place))).write_bytes(zlib.compress(data) if compress else data)
    meta = {"shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "compressor": {"id": "zlib"} if compress else None, "fill_value": 0, "order": "C", "filters": None}
    (folder / "v" / ".zarray").write_text(json.dumps(meta))
    (folder / ".zattrs").write_text(json.dumps({"complete": True, **attributes}))
    if dates:
        first = datetime.date(1990, 1, 1)
        d = np.array([int(f"{first + datetime.timedelta(k):%Y%m%d}") for k in range(len(x))], "<i8")
        (folder / "dates").mkdir()
        (folder / "dates" / "0").write_bytes(d.tobytes())
        (folder / "dates" / ".zarray").write_text(json.dumps({"shape": [len(x)], "chunks": [len(x)], "dtype": "<i8", "compressor": None, "fill_value": 0, "order": "C"}))
    return f"file://{folder}"


def got(df, column: str = "v") -> dict:
    return {r.place: r[column] for r in df.collect()}


def test_ten_of_a_thousand_days_open_their_chunks_only(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).normal(size=(1000, 6, 5)).astype("<f4")
    uri = store(tmp_path, "s", x, (4, 3, 5))
    opened: list[str] = []
    read = files.read_bytes
    monkeypatch.setattr(stores, "read_bytes", lambda u: (opened.append(u), read(u))[1])
    reader = stores.StoreReader([stores.open_segment(uri, ["v"], 0, "", {})], 1, 500, 510)
    opened.clear()
    spans = reader.partitions()
    batches = [b for s in spans for b in reader.read(s)]
    assert len(spans) == 3 and len(opened) == 6 and sum(len(b) for b in batches) == 10  # 3 chunks of 4 days, in 2 parts each
    # Spark opens no more: all other chunks are broken
    for f in (tmp_path / "s" / "v").iterdir():
        if f.name[0] != "." and not 125 <= int(f.name.split(".")[0]) <= 127:
            f.write_bytes(b"broken")
    asked = lambda **more: stores.read_stores(spark, [uri], ["v"], "dates", task_bytes=1, **more)
    ten = asked(first=500, last=510)
    assert got(ten) == {k: x[k].ravel().tolist() for k in range(500, 510)} and ten.rdd.getNumPartitions() == 3
    assert [(r.place, r.date) for r in asked(among=["1991-05-17"]).collect()] == [(501, "1991-05-17")]
    assert sorted(got(ten.where("day in (500, 507)").union(ten.where("day = 509")))) == [500, 507, 509]
    with pytest.raises(Exception, match="incorrect header"):
        asked().collect()
    assert asked(first=500, last=500).count() == 0 == asked(among=[]).count() == asked(among=["1880-01-01"]).count()


def test_segments_in_order_with_parts_of_all_kinds(spark, tmp_path):
    r = np.random.default_rng(2)
    a, b, c = (r.normal(size=(n, 4, 3)) for n in (10, 7, 5))
    one = store(tmp_path, "one", a, (3, 4, 2), compress=False)
    np.save(tmp_path / "two.npy", b)
    (tmp_path / "three.nc").write_bytes(netcdf.file_bytes("t", {"y": 4, "x": 3}, {}, {"v": (["y", "x"], c, {})}))
    uris = [one, f"file://{tmp_path}/two.npy", f"{tmp_path}/three.nc"]
    df = stores.read_stores(spark, uris, ["v"])
    whole = np.concatenate((a, b, c)).reshape(22, -1)
    assert got(df) == {k: v.tolist() for k, v in enumerate(whole)}
    rows = stores.read_stores(spark, uris, ["v"], first=8, last=19).orderBy("place").collect()
    assert [(r.segment, r.day) for r in rows] == [(0, 8), (0, 9), *((1, k) for k in range(7)), (2, 0), (2, 1)]
    assert sorted(got(stores.read_stores(spark, uris, ["v"], first=-3))) == [19, 20, 21]
    assert sorted(got(stores.read_stores(spark, uris, ["v"], first=-22, last=-20))) == [0, 1]
    for first, last in ((5, 23), (-23, None), (9, 8)):
        with pytest.raises(Exception, match="covered"):
            stores.read_stores(spark, uris, ["v"], first=first, last=last).collect()


def test_stores_that_are_not_as_wanted_are_refused(spark, tmp_path):
    x = np.zeros((6, 2, 2), "<f4")
    good = store(tmp_path, "good", x, (2, 2, 2), names=["t2m"])
    want = {"arrays": {"v": {"shape": [2, 2], "dtype": "float32"}}, "attributes": {"complete": True, "names": ["t2m"]}}
    assert stores.read_stores(spark, [good], ["v"], "dates", want).count() == 6
    bad = [
        (store(tmp_path, "open", x, (2, 2, 2), complete=False, names=["t2m"]), ["v"]),
        (store(tmp_path, "names", x, (2, 2, 2), names=["other"]), ["v"]),
        (store(tmp_path, "wide", x.astype("<f8"), (2, 2, 2), names=["t2m"]), ["v"]),
        (store(tmp_path, "shape", np.zeros((6, 2, 3), "<f4"), (2, 2, 3), names=["t2m"]), ["v"]),
        (good, ["v", "w"]),
        (store(tmp_path, "dateless", x, (2, 2, 2), dates=False, names=["t2m"]), ["v"]),
        (f"{tmp_path}/absent", ["v"]),
    ]
    for uri, names in bad:
        with pytest.raises(Exception, match="wanted|attributes|no array|dates"):
            stores.read_stores(spark, [uri], names, "dates", want).collect()
    with pytest.raises(Exception, match="first segment"):
        stores.read_stores(spark, [good, bad[3][0]], ["v"]).collect()


def test_written_stores_and_missing_days(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(9, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x) if k != 4], "day long, vals array<double>")
    assert stores.write_store(df, f"file://{tmp_path}/w", "v", (2, 3), 2) == 9
    back = got(stores.read_stores(spark, [f"file://{tmp_path}/w"], ["v"], want={"attributes": {"complete": True}}))
    assert all(back[k] == x[k].tolist() for k in range(9) if k != 4) and np.isnan(back[4]).all()
    for rows in ([], [(0, [0.0] * 6)] * 2):
        with pytest.raises(ValueError, match="each once"):
            stores.write_store(spark.createDataFrame(rows, "day long, vals array<double>"), f"file://{tmp_path}/x{len(rows)}", "v", (2, 3))


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "i4"])
def test_header_and_records_round_trip(version, dtype):
    r = np.random.default_rng(4)
    x, lat, day = (r.normal(size=(5, 3, 7)) * 100).astype(dtype), np.linspace(-1, 1, 3), np.arange(5.0)
    for records in ({"v": (["lat", "lon"], x, {"units": "K"})}, {"time": ([], day, {"units": "days since 1990-01-01"}), "v": (["lat", "lon"], x, {"add_offset": 2.0})}):
        data = netcdf.file_bytes("time", {"lat": 3, "lon": 7}, {"lat": (["lat"], lat, {})}, records, {"title": "fields", "numbers": [1, 2, 3]}, version)
        f = io.BytesIO(data)
        h = netcdf.read_header(f, len(data))
        assert h.version == version and h.records == 5 and h.dims == {"time": 0, "lat": 3, "lon": 7} and h.attributes == {"title": "fields", "numbers": [1, 2, 3]}
        assert h.variable("v").shape == x.shape and h.variable("v").dims == ["time", "lat", "lon"]
        assert (netcdf.read_rows(f, h, "v", 1, 4) == x[1:4]).all() and (netcdf.read_rows(f, h, "lat", 0, 3) == lat).all()
        open_ended = bytearray(data)
        open_ended[4 : 12 if version == 5 else 8] = b"\xff" * (8 if version == 5 else 4)
        assert netcdf.read_header(io.BytesIO(bytes(open_ended)), len(data)).records == 5
    with pytest.raises(ValueError, match="ends within"):
        netcdf.read_header(io.BytesIO(data[:40]))
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.read_header(io.BytesIO(b"\x89HDF\r\n\x1a\n"))
    with pytest.raises(ValueError, match="no variable"):
        h.variable("w")


def test_holes_scales_and_times():
    x = np.array([1, -99, 3], ">i2")
    out = netcdf.unpacked(x, {"_FillValue": -99, "scale_factor": 0.5, "add_offset": 10.0})
    assert out[0] == 10.5 and np.isnan(out[1]) and out[2] == 11.5
    assert netcdf.unpacked(x.astype(">f4"), {}).dtype == np.float32
    days = netcdf.decoded_dates
    assert days([0, 31, 59], "days since 1996-01-01") == ["1996-01-01", "1996-02-01", "1996-02-29"]
    assert days([0, 59, 365], "days since 1996-01-01", "noleap") == ["1996-01-01", "1996-03-01", "1997-01-01"]
    assert days([29, 30, 360], "days since 2000-01-01 00:00:00", "360_day") == ["2000-01-30", "2000-02-01", "2001-01-01"]
    assert days([11, 12, 36.0], "hours since 2000-02-28T12:00:00Z") == ["2000-02-28", "2000-02-29", "2000-03-01"]
    assert days([86399, 86400], "seconds since 1970-01-01", "proleptic_gregorian") == ["1970-01-01", "1970-01-02"]
    assert days([0], "days since 0850-01-01", "proleptic_gregorian") == ["0850-01-01"]
    for units, calendar in (("furlongs since 1970-01-01", "standard"), ("days", "standard"), ("days since 1970-01-01", "lunar"), ("days since 1500-01-01", "standard")):
        with pytest.raises(ValueError, match="decoded"):
            days([0], units, calendar)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_files_written_by_spark_and_read_by_date(spark, tmp_path, kind):
    x = np.random.default_rng(5).normal(size=(70, 6)).astype("f4" if kind == "float" else "f8")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"day long, vals array<{kind}>")
    names = netcdf.write_netcdf(df, f"file://{tmp_path}/nc", {"lat": 2, "lon": 3}, "t2m", 31, "2000-02-01", {"units": "K"})
    assert [n.rpartition("/")[2] for n in names] == ["t2m-00000000.nc", "t2m-00000031.nc", "t2m-00000062.nc"]
    back = stores.read_stores(spark, names, ["t2m"], "time")
    assert got(back, "t2m") == {k: v.tolist() for k, v in enumerate(x)} and dict(back.dtypes)["t2m"] == f"array<{kind}>"
    (tmp_path / "nc" / "t2m-00000062.nc").write_bytes((tmp_path / "nc" / "t2m-00000062.nc").read_bytes()[:-1000])  # its values are gone, its times too
    early = stores.read_stores(spark, names[:2], ["t2m"], "time", among=["2000-03-01"]).collect()
    assert [(r.place, r.t2m) for r in early] == [(29, x[29].tolist())]
    with pytest.raises(Exception, match="twice"):
        netcdf.write_netcdf(df.union(df.limit(1)), f"file://{tmp_path}/two", {"lat": 2, "lon": 3})


def test_store_queries_go_through_files(spark):
    assert {"stored_day_range", "netcdf_day_lookup"} <= set(registry.queries())
    assert registry.queries()["stored_day_range"](spark, DATA).select("day_idx").distinct().count() == 10
