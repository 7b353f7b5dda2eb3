"""Files in and out."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.sources import files, sinks


def png(path, plane):
    plane = np.asarray(plane, np.uint8)
    h, w = plane.shape[:2]
    kind = 0 if plane.ndim == 2 else 2
    raw = b"".join(b"\0" + plane[r].tobytes() for r in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_csv_and_parts(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.5), ("b", None)], "image string, v double")
    sinks.write_csv(frame, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t"), "image string, v double").collect()), key=str) == [("a", 1.5), ("b", None)]
    (tmp_path / "s.csv").write_text("Image;Label\nx.png;benign\ny.png;\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "s.csv"), "Image string, Label string", ";").collect()] == [("x.png", "benign"), ("y.png", None)]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "s.csv"), "Other string, Label string", ";").collect()
    for start, n in ((0, 2), (2, 3), (9, 1)):
        (tmp_path / f"f_part_{start}_n{n}.csv").write_text("image\n" + "".join(f"i{start + k}\n" for k in range(n)))
    parts = files.read_parts(spark, str(tmp_path / "f_part_*.csv"), "image string")
    assert [r["part_start"] for r in files.part_gaps(parts).collect()] == [9]


def test_json_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "directions": {"a": {"groups": {"basic": {"c": 0.1}, "fused": {"c": 10}}}}\n}')
    doc = files.read_json(spark, str(tmp_path / "s.json"), "directions map<string, struct<groups: map<string, struct<c: double>>>>")
    assert {tuple(r) for r in files.tuned_parameters(doc).collect()} == {("a", "basic", 0.1), ("a", "fused", 10.0)}
    frame = spark.createDataFrame([("r1", "a", 1.0, True), ("r2", "b", 2.0, None)], "run string, k string, v double, ok boolean")
    sinks.write_summary(frame, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 2
    sinks.append_run(frame, str(tmp_path / "runs"), ["run"])
    sinks.append_run(frame.where("run = 'r1'").withColumn("v", F.lit(5.0)), str(tmp_path / "runs"), ["run"])
    assert {(r["run"], r["v"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {("r1", 5.0), ("r2", 2.0)}
    assert sinks.exit_code(frame, "ok") == 2 and sinks.exit_code(frame.where("run = 'r1'"), "ok") == 0
    sinks.write_matrix(frame, str(tmp_path / "m"), "run", "k", "v", ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["run", "a", "b"]
    failed = spark.createDataFrame([("x", "bad", [1.0]), ("y", None, [2.0])], "image string, failure string, pixels array<double>")
    sinks.write_failures(failed, str(tmp_path / "failed"))
    assert spark.read.option("header", True).csv(str(tmp_path / "failed")).collect()[0].asDict() == {"image": "x", "failure": "bad"}


def test_images(spark, tmp_path):
    gray = np.arange(48, dtype=np.uint8).reshape(6, 8)
    rgb = np.zeros((6, 8, 3), np.uint8)
    rgb[:2, :, 0], rgb[2:3, :, 1] = 255, 255
    (tmp_path / "images").mkdir()
    (tmp_path / "masks").mkdir()
    png(tmp_path / "images" / "a.png", gray)
    png(tmp_path / "masks" / "a.png", rgb)
    (tmp_path / "masks" / "INFO.csv").write_text("x")
    image = files.read_images(spark, str(tmp_path / "images"))
    assert image.first()["pixels"] == gray.ravel().tolist()
    colours = files.mask_colours(files.read_images(spark, str(tmp_path / "masks" / "a.png"), "RGB")).first()
    assert (colours["red_pixels"], colours["green_pixels"], colours["foreground_pixels"]) == (16, 8, 24)
    luma = files.read_images(spark, str(tmp_path / "masks" / "a.png")).first()["pixels"]
    assert luma[0] == (255 * 19595 + 0x8000) >> 16 and luma[16] == (255 * 38470 + 0x8000) >> 16
    pair = files.paired_images(image, files.read_images(spark, str(tmp_path / "masks" / "a.png"))).first()
    assert len(pair["mask"]) == 48
    row = files.listing(spark, str(tmp_path / "images")).first()
    assert row["name"] == "a.png" and row["sha256"] == hashlib.sha256((tmp_path / "images" / "a.png").read_bytes()).hexdigest()
    assert files.single_file(spark, str(tmp_path), "INFO.csv").endswith("INFO.csv")
    with pytest.raises(ValueError):
        files.single_file(spark, str(tmp_path), "none.csv")


def test_embeddings(spark, tmp_path):
    good = spark.createDataFrame([("a", [1.0, 2.0])], "image string, embedding array<double>")
    sinks.write_vectors(good, str(tmp_path / "v"))
    assert files.read_embeddings(spark, str(tmp_path / "v"), "image", "embedding", 2).count() == 1
    with pytest.raises(Exception, match="another length"):
        files.read_embeddings(spark, str(tmp_path / "v"), "image", "embedding", 3).collect()
    sinks.write_vectors(spark.createDataFrame([("a", [1.0, float("nan")])], "image string, embedding array<double>"), str(tmp_path / "w"))
    with pytest.raises(Exception, match="non-finite"):
        files.read_embeddings(spark, str(tmp_path / "w"), "image", "embedding", 2).collect()


def test_sheet(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>CaseID</t></si><si><t>Name</t></si><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>8</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.read_sheet(spark, str(path), "Data").collect()] == [("7", "one"), ("8", None)]


def test_fetch(tmp_path):
    source = tmp_path / "source"
    source.write_bytes(b"abc")
    md5 = hashlib.md5(b"abc").hexdigest()
    target = str(tmp_path / "got")
    assert files.fetch(source.as_uri(), target, 3, md5) == target and files.fetch(source.as_uri(), target, 3, md5) == target
    with pytest.raises(ValueError):
        files.fetch(source.as_uri(), target, 4, md5)
