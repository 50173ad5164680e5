import io
import zipfile

from blockloom.plans import pipeline
from blockloom.sources import files, html, markdown, office
from blockloom.sources.model import decoded, format_of, resolved_title
from blockloom.streaming import ingest

MD = """# Guide

Intro line one
line two

## Steps
- first
```py
a  =  1
```
| a | b |
| --- | --- |
| 1 |  2 |
![plan](img/p.png)
"""
HTML = "<html><head><title> A  page </title></head><body><nav><p>menu</p></nav><article><h1>Top</h1><p>one <b>two<p>three</article><ul><li>out</li></ul></body></html>"


def test_markdown():
    got = markdown.parse("/x/guide.md", MD.encode())
    assert got.title == "Guide"
    assert [(i.block_type, i.text) for i in got.items] == [("heading", "Guide"), ("paragraph", "Intro line one line two"), ("heading", "Steps"), ("paragraph", "- first"), ("code", "a  =  1"), ("table", None), ("image", "plan")]
    assert got.items[5].rows == [[" a ", " b "], [" 1 ", "  2 "]]


def test_html_without_implied_ends():
    got = html.parse("/x/p.html", HTML.encode())
    assert got.title == "A page"
    assert [(i.block_type, i.text) for i in got.items] == [("heading", "Top"), ("paragraph", "one two three"), ("paragraph", "three")]


def test_decoding_and_titles():
    assert decoded("﻿x".encode()) == "x" and decoded("水厂".encode("gb18030")) == "水厂"
    assert format_of("/a/B.MD") == "markdown"
    assert resolved_title("report.docx", None, "/a/report.docx") == ("report", "filename_fallback")
    assert resolved_title("Real", "  Inventory ", "/a/x.md") == ("Inventory", "inventory_title")


def office_file(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_docx():
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title here", "Title") + p("Part", "Heading2") + p("") + p("words") + "<w:tbl><w:tr><w:tc>" + p("h") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>" + '<w:p><a:blip r:embed="rId1"/></w:p>'
    got = office.parse_docx("/x/a.docx", office_file({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<R><Q Id="rId1" Target="media/i.png"/></R>', "word/media/i.png": "x"}))
    assert got.title == "Title here" and got.metadata["image_count"] == 1
    assert [(i.block_type, i.text, i.level) for i in got.items] == [("heading", "Title here", 1), ("heading", "Part", 2), ("paragraph", "words", None), ("table", None, None), ("image", None, None)]
    assert got.items[4].image["image_path"] == "word/media/i.png"


def test_xlsx_and_pptx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    x = office_file({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="rId1"/><sheet name="E" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Q Id="rId1" Target="worksheets/a.xml"/><Q Id="rId2" Target="worksheets/b.xml"/></R>',
        "xl/worksheets/a.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row/><row><c r="A3"><f>A1+1</f><v>3</v></c></row></sheetData></worksheet>', "xl/worksheets/b.xml": f"<worksheet {s}><sheetData/></worksheet>", "xl/sharedStrings.xml": f"<sst {s}><si><t>h</t></si></sst>",
    })
    got = office.parse_xlsx("/x/a.xlsx", x).items
    assert [(i.caption, i.rows, i.where) for i in got] == [("工作表：S", [["h", "", "2"], [], ["=A1+1"]], "sheet_0001")]
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    deck = office_file({
        "ppt/presentation.xml": f'<p:presentation {p}><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<R><Q Id="rId1" Target="slides/s.xml"/></R>',
        "ppt/slides/s.xml": f"<p:sld {p}><p:cSld><p:spTree>{shape(9, 'below')}{shape(1, 'above')}<p:pic/></p:spTree></p:cSld></p:sld>",
    })
    got = office.parse_pptx("/x/a.pptx", deck).items
    assert [(i.block_type, i.text, i.page) for i in got] == [("image", None, 1), ("paragraph", "above", 1), ("paragraph", "below", 1)]


def test_directory_to_evaluations(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "guide.MD").write_text(MD)
    (tmp_path / "copy.md").write_text(MD)
    (tmp_path / "page.html").write_text(HTML)
    (tmp_path / "broken.docx").write_text("no zip")
    (tmp_path / "other.txt").write_text("no parser")
    r = pipeline.parse_directory(spark, str(tmp_path))
    assert r.documents.count() == 2 and {x.error_type for x in r.failures.collect()} == {"BadZipFile"}
    assert {(x.document_id[:8], x.status) for x in r.evaluations.collect()} == {("doc_mark", "review_required"), ("doc_html", "finalized")}
    path = {x.text: x.heading_path for x in r.blocks.collect()}
    assert path["a = 1"] == ["Guide", "Steps"]  # code is normalised too
    assert r.candidates.count() == 1


def test_files_must_exist(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        files.scan_files(spark, [str(tmp_path / "none.md")])
    with pytest.raises(ValueError):
        files.scan_files(spark, [str(tmp_path / "x.exe")])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "guide.md").write_text(MD)
    seen = []
    ingest.stream_directory(spark, str(tmp_path / "in"), lambda r, n: seen.append(r.blocks.count()), str(tmp_path / "c1"), once=True).awaitTermination()
    assert seen == [7]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text('{"seq": 2, "decision_id": "d2", "review_id": "r", "selected_action": "approve_native", "reviewer": "x"}\n{"seq": 1, "decision_id": "d1", "review_id": "r", "selected_action": "run_ocr", "reviewer": "x"}\n')
    states = {}
    ingest.stream_states(spark, str(tmp_path / "log"), str(tmp_path / "c2"), lambda df, n: states.update({x.review_id: (x.decision_id, x.status) for x in df.collect()}), once=True).awaitTermination()
    assert states == {"r": ("d2", "decided")}
