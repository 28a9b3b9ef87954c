"""Readers on files made here, and the progress stream against the batch fold."""

import zipfile

from pyspark.sql import functions as F

from textloom.operators import jobs
from textloom.sources import files
from textloom.streaming import progress

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def pack(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一段。\r\n".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "c.txt").write_bytes(b"\xff\xff\xff")
    got = {r.path[-5:]: (r.text, r.encoding) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("第一段。\r\n", "gb18030"), "b.txt": ("hi", "utf-8-sig"), "c.txt": (None, "unsupported_text_encoding")}


def test_office(spark, tmp_path):
    para = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    pack(tmp_path / "d.docx", {
        "word/document.xml": f"<w:document {W}><w:body>{para.format('One')}{para.format(' ')}{para.format('Two')}</w:body></w:document>",
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1">{para.format("x")}</w:footnote><w:footnote w:id="2">{para.format("Note")}</w:footnote></w:footnotes>',
    })
    got = [tuple(r)[1:] for r in files.read_office(spark, str(tmp_path / "d.docx"), "docx").collect()]
    assert got == [("body", 0, 0, "One"), ("body", 0, 2, "Two"), ("footnote", 2, 0, "Note")]
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    pack(tmp_path / "s.pptx", {
        "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape.format('A')}<p:grpSp>{shape.format('B')}</p:grpSp></p:spTree></p:cSld></p:sld>"
    })
    got = [tuple(r)[1:] for r in files.read_office(spark, str(tmp_path / "s.pptx"), "pptx").collect()]
    assert got == [(1, "shape", "1", 0, "A"), (1, "shape", "2.1", 0, "B")]
    pack(tmp_path / "w.xlsx", {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>产品</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><f>1+1</f><v>2</v></c><c r="D1"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    })
    got = [tuple(r)[3:] for r in files.read_office(spark, str(tmp_path / "w.xlsx"), "xlsx").collect()]
    assert got == [("A1", "产品", False, False), ("B1", "x", False, True), ("C1", "2", True, False)]


def test_progress_stream_meets_the_fold(spark, tmp_path):
    rows = [(j, e, (e * 7 + j) % 3, (e * 5) % 11, 10) for j in range(3) for e in range(12)]
    schema = "job long, event_id long, stage long, processed long, total long"
    df = spark.createDataFrame(rows, schema)
    for part in range(2):
        df.where(F.floor(F.col("event_id") / 6) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = progress.monotone(stream).writeStream.format("memory").queryName("progress").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("progress").count() == len(rows)
    accepted = {r.job: r.n for r in spark.table("progress").groupBy("job").agg(F.count_if("accepted").alias("n")).collect()}
    fold = {r.job: r.accepted for r in jobs.fold_progress(df, "job", ["event_id"]).collect()}
    assert accepted == fold
