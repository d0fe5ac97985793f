"""dBASE tables and chunked array groups."""

import json
import struct

import numpy as np
import pytest
import zstandard
from rillflow.sources import arrays, dbf


def write_dbf(path, rows):
    fields = [("COMID", "N", 10, 0), ("uparea", "N", 12, 3), ("name", "C", 8, 0), ("ok", "L", 1, 0)]
    width = 1 + sum(f[2] for f in fields)
    with open(path, "wb") as f:
        f.write(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width))
        for name, kind, size, dec in fields:
            f.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, dec))
        f.write(b"\r")
        for deleted, comid, area, name, ok in rows:
            f.write(b"*" if deleted else b" ")
            f.write(f"{comid:>10}{'' if area is None else f'{area:.3f}':>12}{name:<8}{ok}".encode())


def test_dbf(spark, tmp_path):
    path = str(tmp_path / "r.dbf")
    write_dbf(path, [(False, i, None if i == 3 else i / 2, f"r{i}", "T" if i % 2 else "F") for i in range(11)] + [(True, 99, 1.0, "gone", "T")])
    dbf.register(spark)
    df = spark.read.format("dbf").option("rowsPerTask", "4").load(path)
    assert dict(df.dtypes) == {"COMID": "bigint", "uparea": "double", "name": "string", "ok": "boolean"}
    rows = {r.COMID: r for r in df.collect()}
    assert set(rows) == set(range(11)) and rows[3].uparea is None and rows[7].uparea == 3.5 and rows[7].ok and rows[7]["name"] == "r7"
    assert spark.read.format("dbf").option("columns", "uparea,COMID").load(path).columns == ["uparea", "COMID"]


def write_array(path, values, chunk, codec="zstd", skip=()):
    path.mkdir(parents=True)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if codec:
        codecs.append({"name": codec, "configuration": {}})
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": values.dtype.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0, "codecs": codecs,
    }
    (path / "zarr.json").write_text(json.dumps(meta))
    for ix in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk)]):
        if ix in skip:
            continue
        full = np.zeros(chunk, dtype=values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(ix, chunk))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        raw = full.tobytes()
        where = path.joinpath("c", *map(str, ix))
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(zstandard.ZstdCompressor().compress(raw) if codec else raw)


def write_group(path, **attributes):
    path.mkdir(parents=True)
    (path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}))


def test_adjacency_store(spark, tmp_path):
    root = tmp_path / "net"
    write_group(root, geodataset="lynker", format="COO")
    write_array(root / "order", np.array([10, 20, 40, 30, 50], dtype="int32"), (2,))
    write_array(root / "indices_0", np.array([3, 3, 4, 4], dtype="int32"), (3,), codec=None)
    write_array(root / "indices_1", np.array([0, 1, 2, 3], dtype="int32"), (3,))
    order, pairs, dataset = arrays.read_adjacency_store(spark, str(root))
    assert dataset == "lynker"
    assert {(r.src_id, r.reach_id, r.topo_idx) for r in order.collect()} == {("wb-10", 10, 0), ("wb-20", 20, 1), ("wb-40", 40, 2), ("wb-30", 30, 3), ("wb-50", 50, 4)}
    assert {tuple(r) for r in pairs.collect()} == {(3, 0), (3, 1), (4, 2), (4, 3)}
    bare = tmp_path / "bare"
    write_group(bare)
    with pytest.raises(ValueError):
        arrays.read_adjacency_store(spark, str(bare))
    with pytest.raises(FileNotFoundError):
        arrays.read_adjacency_store(spark, str(tmp_path / "absent"))


def test_gauge_store_and_two_dimensions(spark, tmp_path):
    root = tmp_path / "gauges"
    write_group(root)
    for staid, links in (("00000030", [(3, 0), (3, 1)]), ("00000050", [(4, 2), (4, 3), (3, 0)])):
        write_group(root / staid, gage_catchment=30)
        for k in (0, 1):
            write_array(root / staid / f"indices_{k}", np.array([p[k] for p in links], dtype="int32"), (2,))
    got = {tuple(r) for r in arrays.read_gauge_store(spark, str(root)).collect()}
    assert got == {("00000030", 3, 0), ("00000030", 3, 1), ("00000050", 4, 2), ("00000050", 4, 3), ("00000050", 3, 0)}
    q = np.arange(35, dtype="float32").reshape(5, 7)
    write_group(tmp_path / "flow")
    write_array(tmp_path / "flow" / "Qr", q, (2, 3), skip={(1, 1)})
    arrays.register(spark)
    rows = spark.read.format("zarr").option("arrays", "Qr").load(str(tmp_path / "flow")).collect()
    assert len(rows) == 35
    for r in rows:
        absent = r.i0 // 2 == 1 and r.i1 // 3 == 1
        assert r.Qr == (0 if absent else q[r.i0, r.i1])
