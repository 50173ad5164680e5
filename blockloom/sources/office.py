"""DOCX, XLSX and PPTX files, read from their zip members with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

from blockloom.sources.model import Item, Parsed, normalized

_MAIN = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_CELL_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"


class Package:
    """An office file: its XML members and what they refer to."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def targets(self, name: str) -> dict[str, str]:
        """Relationship ids of a member to the members they point at."""
        root = self.xml(posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels"))
        base = posixpath.dirname(name)
        return {} if root is None else {r.get("Id"): posixpath.normpath(posixpath.join(base, r.get("Target", ""))).lstrip("/") if not r.get("Target", "").startswith("/") else r.get("Target").lstrip("/") for r in root}


def _run_text(node: ElementTree.Element, ns: str) -> str:
    out = []
    for x in node.iter():
        if x.tag == ns + "t":
            out.append(x.text or "")
        elif x.tag == ns + "tab":
            out.append("\t")
        elif x.tag in (ns + "br", ns + "cr"):
            out.append("\n")
    return "".join(out)


def _heading(style: str, text: str) -> int | None:
    """The level of a paragraph that is a heading by its style, or by a Chinese number at its front."""
    if style.startswith(("Heading", "标题")):
        digits = "".join(c for c in style if c.isdigit())
        return int(digits) if digits else 1
    if style == "Title" or len(text) <= 40 and text.startswith(("一、", "二、", "三、", "四、")):
        return 1
    return None


def parse_docx(path: str, content: bytes) -> Parsed:
    pkg, body = Package(content), None
    root = pkg.xml("word/document.xml")
    body = [] if root is None else list(root.find(_MAIN + "body") if root.find(_MAIN + "body") is not None else [])
    styles = {s.get(_MAIN + "styleId"): n.get(_MAIN + "val", "") for s in (pkg.xml("word/styles.xml") if "word/styles.xml" in pkg.names else []) if (n := s.find(_MAIN + "name")) is not None}
    targets, items, title = pkg.targets("word/document.xml"), [], ""
    for index, node in enumerate(n for n in body if n.tag in (_MAIN + "p", _MAIN + "tbl")):
        if node.tag == _MAIN + "tbl":
            rows = [["\n".join(_run_text(p, _MAIN) for p in cell.iter(_MAIN + "p")) for cell in row.findall(_MAIN + "tc")] for row in node.findall(_MAIN + "tr")]
            if any(normalized(c) for row in rows for c in row):
                items.append(Item("docx_tbl", "table", rows=rows, raw_type="table", raw_index=index))
            continue
        text, ref = normalized(_run_text(node, _MAIN)), node.find(f"{_MAIN}pPr/{_MAIN}pStyle")
        style = ref.get(_MAIN + "val", "") if ref is not None else ""
        style = styles.get(style, style)
        style = style[:1].upper() + style[1:] if style.lower().startswith(("heading", "title")) else style
        title = title or text[:100]
        if text:
            level = _heading(style, text)
            items.append(Item("docx_txt", "paragraph" if level is None else "heading", text, level, raw_type="paragraph", raw_index=index))
        for k, blip in enumerate(node.iter(_DRAW + "blip")):
            rid = blip.get(_REL + "embed")
            if rid:
                items.append(Item("docx_img", "image", image={"image_path": targets.get(rid)}, code="DOCX_EMBEDDED_IMAGE", raw_type="paragraph_image", raw_index=k, locator=rid))
    return Parsed(title or PurePosixPath(path).stem, items, {"image_count": sum(n.startswith("word/media/") for n in pkg.names)})


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def parse_xlsx(path: str, content: bytes) -> Parsed:
    pkg = Package(content)
    book = pkg.xml("xl/workbook.xml")
    shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t")) for si in (pkg.xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in pkg.names else [])]
    targets, items, names = pkg.targets("xl/workbook.xml"), [], []
    for s, sheet in enumerate([] if book is None else book.iter(_SHEET + "sheet"), start=1):
        name, member = sheet.get("name", ""), targets.get(sheet.get(_REL + "id"), "")
        names.append(name)
        root = pkg.xml(member)
        rows: list[list[str]] = []
        for row in [] if root is None else root.iter(_SHEET + "row"):
            cells: list[str] = []
            for k, c in enumerate(row.findall(_SHEET + "c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                formula, value = c.find(_SHEET + "f"), c.find(_SHEET + "v")
                if formula is not None and formula.text:
                    cells[at] = "=" + formula.text
                elif c.get("t") == "s" and value is not None and (value.text or "").isdigit() and int(value.text) < len(shared):
                    cells[at] = shared[int(value.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(_SHEET + "t"))
                elif c.get("t") == "b" and value is not None:
                    cells[at] = "True" if value.text == "1" else "False"
                elif value is not None:
                    cells[at] = value.text or ""
            rows.append(cells)
        where = f"sheet_{s:04d}"
        if any(normalized(c) for row in rows for c in row):
            last = f"A1:{_letters(max(map(len, rows)) - 1)}{len(rows)}"
            items.append(Item("tbl", "table", rows=rows, caption=f"工作表：{name}", raw_type="worksheet_table", raw_index=0, locator=last, where=where, number=1))
        drawing = None if root is None else root.find(_SHEET + "drawing")
        member = pkg.targets(member).get(drawing.get(_REL + "id"), "") if drawing is not None else ""
        anchors = [] if pkg.xml(member) is None else [a for a in pkg.xml(member) if any(True for _ in a.iter(_DRAW + "blip"))]
        for k, anchor in enumerate(anchors):
            at = anchor.find(_CELL_DRAW + "from")
            spot = None if at is None else f"{int(at.findtext(_CELL_DRAW + 'row', '0')) + 1},{int(at.findtext(_CELL_DRAW + 'col', '0')) + 1}"
            image = {"image_id": f"{where}_img_{k + 1:04d}", "image_path": f"xlsx://{name}/{k}"}
            items.append(Item("img", "image", image=image, code="XLSX_EMBEDDED_IMAGE", raw_type="worksheet_image", raw_index=k, locator=spot, where=where, number=k + 1))
    return Parsed(PurePosixPath(path).stem, items, {"sheet_names": names})


def parse_pptx(path: str, content: bytes) -> Parsed:
    """Shapes of each slide by top and left edge: tables, texts (the first short one is a heading), pictures."""
    pkg = Package(content)
    deck, targets, items = pkg.xml("ppt/presentation.xml"), pkg.targets("ppt/presentation.xml"), []
    slides = [targets.get(x.get(_REL + "id"), "") for x in ([] if deck is None else deck.iter(_SLIDE + "sldId"))]
    for n, member in enumerate(slides, start=1):
        root = pkg.xml(member)
        shapes = []
        for shape in [] if root is None else root.find(f"{_SLIDE}cSld/{_SLIDE}spTree"):
            if shape.tag.removeprefix(_SLIDE) in ("sp", "graphicFrame", "pic"):
                off = next(shape.iter(_DRAW + "off"), None)
                shapes.append((int(off.get("y", 0)) if off is not None else 0, int(off.get("x", 0)) if off is not None else 0, shape))
        for k, (_, _, shape) in enumerate(sorted(shapes, key=lambda x: x[:2])):
            made = {"page": n, "where": f"slide_{n:04d}", "raw_index": k}
            table = next(shape.iter(_DRAW + "tbl"), None)
            if table is not None:
                rows = [["\n".join(_run_text(p, _DRAW) for p in cell.iter(_DRAW + "p")) for cell in row.findall(_DRAW + "tc")] for row in table.findall(_DRAW + "tr")]
                items.append(Item("tbl", "table", rows=rows, raw_type="shape_table", **made))
            elif shape.tag == _SLIDE + "sp" and shape.find(_SLIDE + "txBody") is not None:
                text = normalized("\n".join(_run_text(p, _DRAW) for p in shape.find(_SLIDE + "txBody").findall(_DRAW + "p")))
                if text:
                    items.append(Item("txt", "heading" if k == 0 and len(text) <= 60 else "paragraph", text, raw_type="shape_text", **made))
            elif shape.tag == _SLIDE + "pic":
                items.append(Item("img", "image", image={}, code="PPTX_PICTURE_SHAPE", raw_type="shape_picture", **made))
    return Parsed(PurePosixPath(path).stem, items, {"slide_count": len(slides)})
