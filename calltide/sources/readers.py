"""Sources: workbooks, JSON records, bindings, feeds and tables; rejects with reasons instead of failures."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sizes beyond which a workbook is refused (fixed values).
MOST_FILE, MOST_CONTENT = 100 << 20, 256 << 20


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook(data: bytes) -> dict[str, list[tuple[int, dict[int, str]]]]:
    """The sheets of a workbook: rows as (number, cells by column), texts, numbers, booleans and formula results as text; errors are left out."""
    if len(data) > MOST_FILE:
        raise ValueError("the workbook is too large")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_CONTENT:
            raise ValueError("the workbook's content is too large")
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        targets = {}
        for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            targets[rel.get("Id")] = "xl/" + rel.get("Target").lstrip("/").removeprefix("xl/")
        out: dict[str, list] = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(s.tag) != "sheet":
                continue
            rid = next(v for k, v in s.attrib.items() if _local(k) == "id")
            rows = []
            for row in ET.fromstring(z.read(targets[rid])).iter():
                if _local(row.tag) != "row":
                    continue
                cells = {}
                for cell in row:
                    kind, value, inline = cell.get("t"), None, None
                    for x in cell.iter():
                        if _local(x.tag) == "v":
                            value = x.text
                        elif _local(x.tag) == "t":
                            inline = (inline or "") + (x.text or "")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = inline
                    elif kind == "b":
                        value = {"1": "true", "0": "false"}.get(value)
                    elif kind == "e":
                        value = None
                    if value not in (None, ""):
                        cells[_column(cell.get("r"))] = value
                rows.append((int(row.get("r") or len(rows) + 1), cells))
            out[s.get("name")] = rows
    return out


def sheet_objects(rows: list[tuple[int, dict[int, str]]], header_row: int = 1) -> list[tuple[int, dict[str, str]]]:
    """Rows below the header as (number, values by name); names that come again get _2, _3; empty cells and rows are left out."""
    header = next((c for n, c in rows if n == header_row), {})
    names, seen = {}, {}
    for col in sorted(header):
        name = header[col].strip()
        seen[name] = seen.get(name, 0) + 1
        names[col] = name if seen[name] == 1 else f"{name}_{seen[name]}"
    out = [(n, {names[c]: v for c, v in cells.items() if c in names}) for n, cells in rows if n > header_row]
    return [(n, values) for n, values in out if values]


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet


class WorkbookSource(DataSource):
    """``spark.read.format("calltide_xlsx").option("sheet", name).load(path)``: sheet, row and a map of values by header; a partition per sheet."""

    @classmethod
    def name(cls) -> str:
        return "calltide_xlsx"

    def schema(self) -> str:
        return "sheet string, row int, cells map<string,string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _WorkbookReader(self.options)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet, self.header = options["path"], options.get("sheet"), int(options.get("headerrow", 1))

    def _bytes(self) -> bytes:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(path) as f:
            return f.read()

    def partitions(self) -> list[_Sheet]:
        return [_Sheet(self.path, s) for s in workbook(self._bytes()) if self.sheet in (None, s)] or [_Sheet(self.path, None)]

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        if partition.sheet is None:
            return
        rows = sheet_objects(workbook(self._bytes())[partition.sheet], self.header)
        cells = pa.array([list(v.items()) for _, v in rows], pa.map_(pa.string(), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([partition.sheet] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), cells], names=["sheet", "row", "cells"])


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("calltide_xlsx")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def records_of(documents: DataFrame) -> DataFrame:
    """Records (variants) of JSON documents in ``value``: an array, or one in opportunities, records or data."""
    raw = documents.select(F.try_parse_json("value").alias("v"))
    wraps = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("opportunities", "records", "data")]
    return raw.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *wraps)).alias("record"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, each a document of its own."""
    return records_of(spark.read.text(path, wholetext=True))


def bindings(rows: DataFrame) -> DataFrame:
    """One row per item of query bindings (item, site, country, dissolved, series): dissolved items and those with a series are left out."""
    g = rows.groupBy("item").agg(F.array_sort(F.collect_set("site")).alias("sites"), F.min("country").alias("country"), F.bool_or(F.coalesce(F.col("dissolved"), F.lit(False))).alias("gone"), F.bool_or(F.col("series").isNotNull()).alias("part"))
    return g.where("not gone and not part").select("item", "sites", "country")


def changed_cards(cards: DataFrame, state: DataFrame) -> DataFrame:
    """Listing cards whose hash is new or differs from the state's."""
    both = cards.join(state.select("card_id", F.col("card_hash").alias("known")), "card_id", "left")
    return both.where(~F.col("known").eqNullSafe(F.col("card_hash"))).drop("known")


def due_pages(urls: DataFrame, state: DataFrame, now, days: int) -> DataFrame:
    """URLs not read within ``days``."""
    recent = state.where(F.col("read_at") > now - F.make_dt_interval(F.lit(days))).select("url")
    return urls.join(recent, "url", "left_anti")


def rectangular(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Every column of the list, in its order, with a default for what is missing; a column that is not there is its default."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(d)).alias(c) if c in rows.columns and d is not None else F.col(c) if c in rows.columns else F.lit(d).alias(c) for c, d in defaults.items()])


#: Sheets of a data set that hold series and portals, and the sheet by which a benchmark is known (fixed values).
SERIES_SHEETS = ("Dataset", "Editions")
PORTAL_SHEETS = ("Monitor list", "Local channels", "Sources")
HELD_OUT_SHEET = "Benchmark_Items"


def dataset_rows(sheets: DataFrame, name: str) -> DataFrame:
    """(kind, dataset, row, cells) of a data set's sheets (sheet, row, cells): series and portals; a workbook of the benchmark is refused."""
    if sheets.where(F.col("sheet") == HELD_OUT_SHEET).head(1):
        raise ValueError(f"{name} holds the benchmark, which is no seed")
    kind = F.when(F.col("sheet").isin(*SERIES_SHEETS), "series").when(F.col("sheet").isin(*PORTAL_SHEETS), "portal")
    return sheets.where(kind.isNotNull()).select(kind.alias("kind"), F.concat(F.lit(f"{name}#"), "sheet").alias("dataset"), "row", "cells")


def inventory(cells: DataFrame) -> DataFrame:
    """(sheet, nonempty_rows, nonempty_cells, header_row, columns) of (sheet, row, values array): the header is the fullest of the first five rows that are not empty, the first on ties."""
    rows = cells.withColumn("values", F.filter("values", lambda v: v.isNotNull() & (v != ""))).where(F.size("values") > 0)
    # the first five rows of a sheet: the five smallest numbers, kept in bounded arrays by task
    totals = rows.groupBy("sheet").agg(F.count("*").alias("nonempty_rows"), F.sum(F.size("values")).alias("nonempty_cells"))
    w = Window.partitionBy("sheet").orderBy("row")
    head = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("sheet").agg(F.min_by(F.struct("row", "values"), F.struct(-F.size("values"), F.col("row"))).alias("h"))
    return totals.join(head, "sheet").select("sheet", "nonempty_rows", "nonempty_cells", F.col("h.row").alias("header_row"), F.col("h.values").alias("columns"))


#: Templates of curated sources: family, tier, type and minutes between checks, by kind; and the sources as (name, url, kind, categories).
TEMPLATES = {
    "site": ("official-site", 2, "official", 4_320), "directory": ("opportunity-directory", 1, "community", 1_440), "fund": ("film-funding", 1, "official", 2_880), "residency": ("media-art-residency", 2, "official", 4_320),
    "creative": ("ai-creative-tech", 1, "official", 1_440), "festival": ("structured-festival", 1, "community", 1_440), "news": ("news-feed", 3, "press", 720),
}


def catalogue(spark: SparkSession, entries: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    """Curated sources out of templates: a short constant list of (name, url, kind, categories) makes full source rows; a URL that comes twice counts once."""
    rows = {url: (name, url, tier, tier, True, type_, family, categories, 360, minutes, 43_200) for name, url, kind, categories in reversed(entries) for family, tier, type_, minutes in [TEMPLATES[kind]]}
    return spark.createDataFrame(
        list(rows.values()),
        "name string, url string, tier int, priority int, enabled boolean, source_type string, source_family string, opportunity_categories array<string>, min_poll_interval_minutes int, poll_interval_minutes int, max_poll_interval_minutes int",
    )


def demo(spark: SparkSession) -> DataFrame:
    """Eight calls for a catalogue without a table."""
    kinds = ["AI film festival", "Traditional festival", "Platform challenge", "Grant", "Residency", "Advertising competition", "AI film festival", "Grant"]
    rows = [(i, f"demo-{i}", f"Demo call {i}", k, "open") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "id bigint, slug string, title string, category string, status string")
