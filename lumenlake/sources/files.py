"""Tables and pictures from files, with declared schemas."""

from __future__ import annotations

import hashlib
import io
import re
import urllib.request
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlake.session import ship


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, separator: str = ",") -> DataFrame:
    """A CSV table with a header and a declared schema; a header of other names is an error, an empty field is null."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("enforceSchema", False).csv(path)


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Part files ``..._part_<start>_n<rows>...`` of one table, with part_start and part_rows read from their names."""
    rows = read_csv(spark, pattern, schema)
    name = F.input_file_name()
    return rows.withColumns({"part_start": F.regexp_extract(name, r"_part_(\d+)_n(\d+)", 1).cast("long"), "part_rows": F.regexp_extract(name, r"_part_(\d+)_n(\d+)", 2).cast("long")})


def part_gaps(parts: DataFrame) -> DataFrame:
    """Parts that do not begin where the one before ends, or hold another number of rows than their name says."""
    from pyspark.sql import Window

    sums = parts.groupBy("part_start", "part_rows").agg(F.count(F.lit(1)).alias("rows"))
    expected = F.coalesce(F.lag(F.col("part_start") + F.col("part_rows")).over(Window.orderBy("part_start")), F.lit(0))
    return sums.withColumn("expected_start", expected).where((F.col("expected_start") != F.col("part_start")) | (F.col("rows") != F.col("part_rows")))


def row_range(frame: DataFrame, order: str, start: int, limit: int | None = None) -> DataFrame:
    """Rows start, start + 1, ... by their stored number, ``limit`` of them (None: to the end); the filter reaches the scan."""
    rows = frame.where(F.col(order) >= start)
    return rows if limit is None else rows.where(F.col(order) < start + limit)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents of many lines each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def tuned_parameters(summary: DataFrame) -> DataFrame:
    """direction, feature_group, c of a summary document {directions: {<direction>: {groups: {<group>: {c}}}}} given as maps."""
    rows = summary.select(F.explode("directions").alias("direction", "d")).select("direction", F.explode("d.groups").alias("feature_group", "g"))
    return rows.select("direction", "feature_group", "g.c")


def read_embeddings(spark: SparkSession, path: str, key: str, column: str, dimension: int) -> DataFrame:
    """Vectors keyed by name; one of another length or with a non-finite component fails when it is read."""
    rows = spark.read.parquet(path)
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checked = F.when(F.size(v) != dimension, F.raise_error(F.lit("vector of another length")).cast(rows.schema[column].dataType)).when(~finite, F.raise_error(F.lit("non-finite vector")).cast(rows.schema[column].dataType)).otherwise(v)
    return rows.select(key, checked.alias(column))


def listing(spark: SparkSession, path: str, pattern: str = "*.png", recursive: bool = False) -> DataFrame:
    """name, path, length, sha256, md5 of files, digests computed where the bytes are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    rows = (reader.option("recursiveFileLookup", True) if recursive else reader).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def single_file(spark: SparkSession, path: str, name: str) -> str:
    """The one file of a name below a folder; ValueError for none or several."""
    found = [r["path"] for r in listing(spark, path, name, recursive=True).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} files {name} below {path}")
    return found[0]


def read_images(spark: SparkSession, path: str | list[str], mode: str = "L") -> DataFrame:
    """name, height, width, pixels of image files (decoded by the JVM): gray by integer luma, or ``RGB`` as three planes' interleaved bytes."""
    ship(spark)
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    rows = rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", "nChannels", "data")
    gray = mode == "L"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, n, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if not data or h < 1:
                    out.append(None)
                    continue
                plane = np.frombuffer(data, np.uint8).reshape(h, w, n)
                if n == 1:
                    rgb = np.repeat(plane, 3, axis=2)
                else:
                    rgb = plane[..., 2::-1] if n == 3 else plane[..., [2, 1, 0]]  # stored as blue, green, red
                luma = (rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16 if n > 1 else plane[..., 0].astype(np.int64)
                out.append((luma if gray else rgb.astype(np.int64)).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["name", "height", "width", "pixels"])

    return rows.mapInArrow(run, "name string, height int, width int, pixels array<long>")


def paired_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images beside the masks of the same name: name, height, width, pixels, mask; a mask of another size is null."""
    m = masks.select("name", F.col("height").alias("mask_height"), F.col("width").alias("mask_width"), F.col("pixels").alias("mask_pixels"))
    joined = images.join(m, "name")
    same = (F.col("height") == F.col("mask_height")) & (F.col("width") == F.col("mask_width"))
    return joined.select("name", "height", "width", F.col("pixels").cast("array<double>").alias("pixels"), F.when(same, F.col("mask_pixels")).cast("array<int>").alias("mask"))


def mask_colours(masks_rgb: DataFrame) -> DataFrame:
    """name, red_pixels, green_pixels, foreground_pixels of RGB masks: above 200 in the channel and below 50 in the others."""
    p = F.col("pixels")
    thirds = F.sequence(F.lit(0), (F.size(p) / 3).cast("int") - 1)
    pixel = F.transform(thirds, lambda i: F.struct(F.get(p, i * 3).alias("r"), F.get(p, i * 3 + 1).alias("g"), F.get(p, i * 3 + 2).alias("b")))
    rows = masks_rgb.withColumn("_px", pixel)
    count = lambda test: F.size(F.filter("_px", test)).cast("long")
    return rows.select(
        "name",
        count(lambda x: (x["r"] > 200) & (x["g"] < 50) & (x["b"] < 50)).alias("red_pixels"),
        count(lambda x: (x["g"] > 200) & (x["r"] < 50) & (x["b"] < 50)).alias("green_pixels"),
        count(lambda x: (x["r"] > 0) | (x["g"] > 0) | (x["b"] > 0)).alias("foreground_pixels"),
    )


def fetch(url: str, path: str, size: int, md5: str) -> str:
    """Download to a new local file and verify its size and MD5; an existing right file is kept, another one is an error."""
    target = Path(path)

    def right() -> bool:
        return target.stat().st_size == size and hashlib.md5(target.read_bytes()).hexdigest() == md5

    if target.exists():
        if not right():
            raise ValueError(f"{path} exists and differs")
        return path
    part = target.with_suffix(target.suffix + ".part")
    with urllib.request.urlopen(url) as answer, part.open("wb") as out:  # noqa: S310
        while block := answer.read(1 << 20):
            out.write(block)
    part.rename(target)
    if not right():
        target.unlink()
        raise ValueError(f"{url} gave other bytes than expected")
    return path


# ------------------------------------------------------------------ spreadsheets


def _sheet_rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Cells of a sheet as text, row by row (Office Open XML)."""
    names = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        read = lambda p: ElementTree.fromstring(book.read(p))
        shared = ["".join(t.text or "" for t in s.iter(f"{{{names['m']}}}t")) for s in read("xl/sharedStrings.xml").findall("m:si", names)] if "xl/sharedStrings.xml" in book.namelist() else []
        links = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        found = [s for s in read("xl/workbook.xml").iterfind("m:sheets/m:sheet", names) if s.get("name") == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet}")
        target = links[found[0].get(relation)].lstrip("/")
        for row in read(target if target.startswith("xl/") else f"xl/{target}").iterfind("m:sheetData/m:row", names):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.findall("m:c", names)):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                value, kind = c.find("m:v", names), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{names['m']}}}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else value.text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


class SpreadsheetSource(DataSource):
    """``spark.read.format("lumenlake_sheet").option("sheet", name).schema(...).load(path)``: a sheet with a header row."""

    @classmethod
    def name(cls) -> str:
        return "lumenlake_sheet"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            header = next(_sheet_rows(f.read(), self.options["sheet"]), [])
        return ", ".join(f"`{c}` string" for c in header if c)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SheetReader(self.options, schema)


class _SheetReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.fields = dict(options), [(f.name, f.dataType.typeName()) for f in schema.fields]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.options["path"], "rb") as f:
            rows = _sheet_rows(f.read(), self.options["sheet"])
            header = next(rows, [])
            turn = {"integer": lambda v: int(float(v)), "long": lambda v: int(float(v)), "double": float, "float": float, "boolean": lambda v: v.lower() in ("1", "true", "yes")}
            for row in rows:
                cells = dict(zip(header, row, strict=False))
                yield tuple(None if cells.get(n) in (None, "") else turn.get(t, str)(cells[n]) for n, t in self.fields)


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A sheet of a spreadsheet file on a path that driver and executors both see, all columns as text."""
    ship(spark)
    spark.dataSource.register(SpreadsheetSource)
    rows = spark.read.format("lumenlake_sheet").option("sheet", sheet).load(path)
    return rows.select(*columns) if columns else rows
