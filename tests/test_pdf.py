"""PDF files made here: simple and composite fonts, Flate, object streams, pictures, damage."""

import zlib

import pytest

from blockloom.plans import pipeline
from blockloom.sources import pdf


def obj(n, body, stream=None, flate=True):
    if stream is None:
        return b"%d 0 obj\n%s\nendobj\n" % (n, body)
    data = zlib.compress(stream) if flate else stream
    head = b"<< %s /Length %d %s >>" % (body, len(data), b"/Filter /FlateDecode" if flate else b"")
    return b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (n, head, data)


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0003> <6C34> endbfrange 1 beginbfchar <0010> <538B> endbfchar endcmap"


def made(packed=False):
    text = (
        b"BT /F1 10 Tf 50 700 Td (The water council approved) Tj 0 -12 Td [(the an) -20 (nual report\\051 \\()] TJ ET q 200 0 0 100 50 300 cm /Im Do Q BT /F1 10 Tf 50 500 Td (Far below \\(caf\\351\\)) Tj 60 0 Td (right) Tj ET\n"
        b"BT /F2 12 Tf 1 0 0 1 50 450 Tm <000100100002> Tj ET"
    )
    page2 = b"BT /F1 10 Tf 50 20 Td (12) Tj 0 500 Td (Second page of it) Tj ET"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im 9 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [11 0 R] >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b"500 " * 224 + b"] >>",
        6: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>", 7: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [1 [1000 1000] 3 5 900] >>", 12: b"<< /Title (Annual report) >>",
    }
    out = b"%PDF-1.5\n"
    if packed:
        heads, bodies = [], b""
        for n, body in parts.items():
            heads.append(b"%d %d" % (n, len(bodies)))
            bodies += body + b" "
        head = b" ".join(heads) + b" "
        out += obj(20, b"/Type /ObjStm /N %d /First %d" % (len(parts), len(head)), head + bodies) + obj(21, b"/Type /XRef /Root 1 0 R /Info 12 0 R", b"")
    else:
        out += b"".join(obj(n, body) for n, body in parts.items()) + b"trailer << /Root 1 0 R /Info 12 0 R >>\n"
    return out + obj(8, b"", CMAP) + obj(9, b"/Type /XObject /Subtype /Image /Width 2 /Height 1", b"\0\1", False) + obj(10, b"", text) + obj(11, b"", page2, False)


@pytest.mark.parametrize("packed", [False, True])
def test_words_and_pictures(packed):
    got = pdf.parse("a/x.pdf", made(packed))
    words = [(i.page, i.text) for i in got.items if i.kind == "word"]
    assert got.title == "Annual report" and got.metadata == {"page_count": 2}
    assert [w for p, w in words if p == 1] == ["The", "water", "council", "approved", "the", "annual", "report)", "(", "Far", "below", "(café)", "right", "水压氵"] and [w for p, w in words if p == 2] == ["12", "Second", "page", "of", "it"]
    picture = next(i for i in got.items if i.block_type == "image")
    assert picture.box == [50, 400, 250, 500] and picture.page == 1
    first = next(i for i in got.items if i.kind == "word")
    assert first.box == [50.0, 92.0, 65.0, 102.0] and first.page_height == 800


def test_what_cant_be_read():
    for bad in (b"", b"no pdf"):
        with pytest.raises(ValueError):
            pdf.parse("x.pdf", bad)
    with pytest.raises(ValueError):
        pdf.parse("x.pdf", made() + b"trailer << /Encrypt 9 0 R >>")
    assert pdf.parse("a/stem.pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n<<<<[[(((").items == []
    for cut in range(0, len(made()), 37):
        pdf.parse("a/x.pdf", b"%PDF-1.5\n" + made()[9:cut])  # damage ends no batch


def test_pipeline(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(made())
    (tmp_path / "bad.pdf").write_bytes(b"broken")
    (tmp_path / "a.md").write_text("# T\n\nwords of it\n")
    r = pipeline.parse_directory(spark, str(tmp_path))
    rows = r.blocks.orderBy("document_id", "pos").collect()
    assert [(x.block_type, x.page_start, x.text) for x in rows if "_pdf_" in x.block_id] == [("paragraph", 1, "The water council approved the annual report) ("), ("paragraph", 1, "Far below (café)right"), ("paragraph", 1, "水压氵"), ("image", 1, None), ("paragraph", 2, "Second page of it")]
    assert [x.text for x in rows if "_md_" in x.block_id] == ["T", "words of it"]
    assert [(x.path[-7:], x.error_type) for x in r.failures.collect()] == [("bad.pdf", "ValueError")]
