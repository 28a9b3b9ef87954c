"""Files as tables: text with its encoding, and office documents through a Python data source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(content: bytes) -> tuple[str | None, str]:
    """Text and encoding; text is null where neither encoding fits (O-01)."""
    if content.startswith(b"\xef\xbb\xbf"):
        names = ("utf-8-sig",)
    else:
        names = ("utf-8", "gb18030")
    for name in names:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return None, "unsupported_text_encoding"


def _mapped(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows (path, ...) that ``rows_of(content)`` yields for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path, *row) for row in rows_of(content.as_py())]
                if rows:
                    columns = [pa.array(list(c)) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names)

    found = [f.strip().split(" ") for f in schema.split(",")]
    names = [n for n, _ in found]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[t] for _, t in found]
    return df.select("path", "content").mapInArrow(run, schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of text files."""
    return _mapped(spark.read.format("binaryFile").load(path), "path string, text string, encoding string", lambda c: [decode(c)])


def _runs(paragraph: ElementTree.Element, run: str, text: str) -> str:
    return "".join(t.text or "" for r in paragraph.iter(run) for t in r.iter(text))


def document_paragraphs(content: bytes) -> list[tuple[str, int, int, str]]:
    """(story, story index, paragraph, text) of a word-processor file: body, headers, footers, notes; blank
    paragraphs and separator notes are left out (O-10)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        names = sorted(pack.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        for story, pattern in (("body", r"word/document\.xml"), ("header", r"word/header\d*\.xml"), ("footer", r"word/footer\d*\.xml")):
            for index, name in enumerate(n for n in names if re.fullmatch(pattern, n)):
                root = ElementTree.fromstring(pack.read(name))
                for i, p in enumerate(root.iter(f"{_W}p")):
                    if (text := _runs(p, f"{_W}r", f"{_W}t")).strip():
                        out.append((story, index, i, text))
        for story in ("footnote", "endnote"):
            if f"word/{story}s.xml" in names:
                for note in ElementTree.fromstring(pack.read(f"word/{story}s.xml")).iter(f"{_W}{story}"):
                    number = int(note.get(f"{_W}id", "-1"))
                    if number >= 0 and note.get(f"{_W}type") not in ("separator", "continuationSeparator"):
                        for i, p in enumerate(note.iter(f"{_W}p")):
                            if (text := _runs(p, f"{_W}r", f"{_W}t")).strip():
                                out.append((story, number, i, text))
    return out


def slide_paragraphs(content: bytes) -> list[tuple[int, str, str, int, str]]:
    """(slide, scope, shape path, paragraph, text): shapes through groups by their path from 1, table cells
    that are not covered by a merge, and notes (O-11, O-12)."""
    out: list[tuple[int, str, str, int, str]] = []

    def walk(parent: ElementTree.Element, slide: int, prefix: tuple[int, ...]) -> None:
        shapes = [c for c in parent if c.tag in (f"{_P}sp", f"{_P}grpSp", f"{_P}graphicFrame", f"{_P}pic", f"{_P}cxnSp")]
        for number, shape in enumerate(shapes, 1):
            path = (*prefix, number)
            name = ".".join(map(str, path))
            if shape.tag == f"{_P}grpSp":
                walk(shape, slide, path)
            elif shape.tag == f"{_P}sp" and (body := shape.find(f"{_P}txBody")) is not None:
                add(body, slide, "shape", name)
            for r, row in enumerate(shape.iter(f"{_A}tr")):
                for c, cell in enumerate(row.findall(f"{_A}tc")):
                    if cell.get("hMerge") != "1" and cell.get("vMerge") != "1" and (body := cell.find(f"{_A}txBody")) is not None:
                        add(body, slide, "table", f"{name}:{r}:{c}")

    def add(body: ElementTree.Element, slide: int, scope: str, name: str) -> None:
        for i, p in enumerate(body.findall(f"{_A}p")):
            if (text := _runs(p, f"{_A}r", f"{_A}t")).strip():
                out.append((slide, scope, name, i, text))

    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        slides = sorted(int(m[1]) for n in pack.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number in slides:
            tree = ElementTree.fromstring(pack.read(f"ppt/slides/slide{number}.xml")).find(f"{_P}cSld/{_P}spTree")
            if tree is not None:
                walk(tree, number, ())
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in pack.namelist():
                for body in ElementTree.fromstring(pack.read(notes)).iter(f"{_P}txBody"):
                    add(body, number, "notes", "")
    return out


def sheet_cells(content: bytes) -> list[tuple[int, str, str, str, bool, bool]]:
    """(sheet, name, ref, text, formula, merged child) of a workbook's string cells (O-13)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in pack.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(pack.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        book = ElementTree.fromstring(pack.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(pack.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
            target = links[sheet.get(f"{_R}id")]
            root = ElementTree.fromstring(pack.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            covered = set()
            for merge in root.iter(f"{_S}mergeCell"):
                first, _, last = merge.get("ref", "").partition(":")
                covered |= _cells(first, last or first) - {first}
            for cell in root.iter(f"{_S}c"):
                kind, formula = cell.get("t"), cell.find(f"{_S}f") is not None
                raw = cell.findtext(f"{_S}v")
                text = shared[int(raw)] if kind == "s" and raw else "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else raw
                if text is not None and (kind in ("s", "inlineStr", "str") or formula):
                    out.append((number, sheet.get("name"), cell.get("r"), text, formula, cell.get("r") in covered))
    return out


def _cells(first: str, last: str) -> set[str]:
    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
        column = 0
        for c in letters:
            column = column * 26 + ord(c) - 64
        return column, int(digits)

    def name(column: int) -> str:
        out = ""
        while column:
            column, rest = divmod(column - 1, 26)
            out = chr(65 + rest) + out
        return out

    (a, b), (c, d) = place(first), place(last)
    return {f"{name(x)}{y}" for x in range(a, c + 1) for y in range(b, d + 1)}


_SCHEMAS = {
    "docx": ("path string, story string, story_index int, paragraph int, text string", document_paragraphs),
    "pptx": ("path string, slide int, scope string, shape string, paragraph int, text string", slide_paragraphs),
    "xlsx": ("path string, sheet int, name string, ref string, text string, formula boolean, merged boolean", sheet_cells),
}


def read_office(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Paragraphs or cells of office files (O-10 to O-13); files are read by Spark, so from any store."""
    schema, rows_of = _SCHEMAS[kind]
    return _mapped(spark.read.format("binaryFile").load(path), schema, rows_of)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Providers, models and pairs of a catalog document (O-16)."""
    raw = spark.read.option("multiLine", True).json(path)
    part = lambda name: raw.select(F.inline(name))
    return part("providers"), part("models"), part("provider_models")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a manifest that are well formed: safe relative paths, digests, positive sizes (O-17)."""
    raw = spark.read.option("multiLine", True).json(path).select(F.inline("assets"))
    safe = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\") & (F.col("path") != "")
    return raw.where(safe & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("size_bytes") > 0))


def verify_assets(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether each asset's file has the manifest's size and digest (O-18); ``files``: path, content."""
    seen = files.select("path", F.sha2("content", 256).alias("__digest"), F.length("content").alias("__size"))
    joined = manifest.join(seen, "path", "left")
    return joined.withColumn("valid", F.coalesce((F.col("__digest") == F.col("sha256")) & (F.col("__size") == F.col("size_bytes")), F.lit(False))).drop("__digest", "__size")


def publish(df: DataFrame, path: str) -> None:
    """Write with the commit protocol: readers see all of it or nothing (O-09)."""
    df.write.mode("overwrite").parquet(path)
