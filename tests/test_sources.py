import struct

import pytest

from parcelon import sources


def dbf(path, names, rows, cut=0):
    """Fields of 10 bytes; a row is (flag, values)."""
    width = 1 + 10 * len(names)
    head = struct.pack("<4xIHH20x", len(rows), 33 + 32 * len(names), width)
    for n in names:
        head += struct.pack("<11sc4xB15x", n.encode(), b"C", 10)
    body = b"".join(f.encode() + b"".join(v.encode("utf-8").ljust(10) for v in vs) for f, vs in rows)
    path.write_bytes(head + b"\r" + body[: len(body) - cut] + (b"" if cut else b"\x1a"))


def shp(path, shapes):
    """Each shape is a list of rings, or None."""
    records, index, at = b"", b"", 50
    for number, rings in enumerate(shapes, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            flat = [p for r in rings for p in r]
            xs, ys = [p[0] for p in flat], [p[1] for p in flat]
            starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
            content = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        records += struct.pack(">2i", number, len(content) // 2) + content
        index += struct.pack(">2i", at, len(content) // 2)
        at += 4 + len(content) // 2
    for name, body in ((path, records), (path.with_suffix(".shx"), index)):
        name.write_bytes(struct.pack(">i20xi", 9994, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)


OUTER, HOLE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


@pytest.fixture
def readers(spark):
    sources.register(spark)
    return spark.read


def test_dbf_rows_and_deleted_rows(readers, tmp_path):
    dbf(tmp_path / "a.dbf", ["N1", "CODE"], [(" ", ["é", "00123"]), ("*", ["x", "1"]), (" ", ["", "2"])])
    read = lambda **o: [tuple(r) for r in readers.format("dbf").options(records=2, **o).load(str(tmp_path / "a.dbf")).orderBy("rec").collect()]
    assert read() == [(0, False, "é", "00123"), (2, False, "", "2")]
    assert [r[1] for r in read(deleted="keep")] == [False, True, False]


def test_cut_off_dbf_fails(readers, tmp_path):
    dbf(tmp_path / "a.dbf", ["N1"], [(" ", ["x"])] * 3, cut=4)
    with pytest.raises(Exception, match="cut off"):
        readers.format("dbf").load(str(tmp_path / "a.dbf")).collect()


def test_shp_rings_nulls_and_positional_join(readers, tmp_path):
    shp(tmp_path / "a.shp", [[OUTER, HOLE], None, [OUTER]])
    found = readers.format("shp").option("records", 1).load(str(tmp_path / "a.shp"))
    rows = found.orderBy("rec").collect()
    assert [[(p.x, p.y) for p in r] for r in rows[0].rings] == [OUTER, HOLE]
    assert (rows[0].xmin, rows[0].ymax, rows[1].rings, rows[1].xmin) == (0.0, 4.0, None, None)
    dbf(tmp_path / "a.dbf", ["N1"], [(" ", ["a"]), ("*", ["b"]), (" ", ["c"])])
    names = readers.format("dbf").option("deleted", "keep").load(str(tmp_path / "a.dbf"))
    joined = sources.positional_join(names, found)
    assert [(r.rec, r.N1) for r in joined.orderBy("rec").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(Exception, match="counts differ"):
        sources.positional_join(names.where("rec < 2"), found).collect()


def test_other_files_fail(readers, tmp_path):
    (tmp_path / "a.shp").write_bytes(b"\0" * 200)
    (tmp_path / "a.shx").write_bytes(b"\0" * 200)
    with pytest.raises(Exception, match="not a shapefile"):
        readers.format("shp").load(str(tmp_path / "a.shp")).collect()


def test_dbf_writer_round_trip(spark, readers, tmp_path):
    path = tmp_path / "out.dbf"
    rows = [(f"{i:05d}", "é" if i % 2 else None) for i in range(7)]
    df = spark.createDataFrame(rows, "code string, name string").orderBy("code").repartitionByRange(3, "code")
    save = lambda frame, mode="append", fields="code:5,name:10": frame.write.format("dbf").option("path", str(path)).option("fields", fields).mode(mode).save()
    save(df)
    found = spark.read.format("dbf").option("path", str(path)).load().orderBy("rec").collect()
    assert [(r["rec"], r["code"], r["name"]) for r in found] == [(i, c, n or "") for i, (c, n) in enumerate(rows)]
    with pytest.raises(Exception, match="FileExists|exists"):
        save(df)
    with pytest.raises(Exception, match="over 4 bytes"):
        save(df, "overwrite", "code:4")
    save(df.where("code = 'x'"), "overwrite")
    assert spark.read.format("dbf").option("path", str(path)).load().count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["out.dbf"]
