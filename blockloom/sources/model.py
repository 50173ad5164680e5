"""What an adapter gives for one file: items in reading order, turned into numbered blocks in one place."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

#: Suffixes and their formats; versions written into metadata.
FORMATS = {".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".pptx": "pptx"}
VERSIONS = {"pipeline_version": "0.6.0", "parser_version": "1.2", "schema_version": "1.0"}
BLOCK_TYPE = (
    "array<struct<block_id:string,block_type:string,text:string,table_data:struct<caption:string,headers:array<string>,rows:array<array<string>>,notes:array<string>>,"
    "image:struct<image_id:string,caption:string,ocr_text:string,image_path:string,width:double,height:double>,page_start:int,page_end:int,bbox:array<double>,heading_path:array<string>,"
    "heading_level:int,page_height:double,ocr_decision:string,ocr_reason_codes:array<string>,raw_object_type:string,raw_object_index:int,raw_locator:string,quality_flags:array<string>,block_order:int>>"
)


@dataclass
class Item:
    """One thing an adapter found. kind is the part of the block id that names it."""

    kind: str
    block_type: str
    text: str | None = None
    level: int | None = None
    rows: list[list[str]] | None = None
    caption: str | None = None
    image: dict | None = None
    page: int | None = None
    code: str | None = None
    raw_type: str = ""
    raw_index: int | None = None
    locator: str | None = None
    where: str = ""  # between document and kind in the block id
    number: int | None = None  # instead of the running order in the block id
    box: list[float] | None = None
    page_height: float | None = None


@dataclass
class Parsed:
    title: str
    items: list[Item]
    metadata: dict = field(default_factory=dict)


def normalized(text: object) -> str:
    """The same rules as functions.text.normalize_text, for the bytes-to-blocks stage."""
    t = ("" if text is None else str(text)).replace("　", " ")
    t = re.sub(r"[ \t\r\f\v]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def format_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no parser for files with suffix {suffix or '(none)'}")
    return FORMATS[suffix]


def decoded(content: bytes) -> str:
    """Text of a file: UTF-8 with or without a mark, else GB 18030, else UTF-8 without what isn't."""
    for codec in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            return content.decode(codec)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


def table_of(rows: list[list[object]], caption: str | None) -> dict:
    """Normalised cells, rows with any text, filled up to the widest, the first as headers."""
    kept = [r for r in ([normalized(c) for c in row] for row in rows) if any(r)]
    width = max(map(len, kept), default=0)
    kept = [r + [""] * (width - len(r)) for r in kept]
    return {"caption": caption, "headers": kept[0] if kept else [], "rows": kept[1:], "notes": []}


def filename_like(title: str, path: str) -> bool:
    t, p = title.lower().strip(), PurePosixPath(path)
    return t in {p.stem.lower(), p.name.lower(), "untitled", "document"} or re.search(r"seed_\d+|\.(?:pdf|docx?|xlsx?|pptx?|html?|md)$", t) is not None


def resolved_title(reported: str, inventory: str | None, path: str) -> tuple[str, str]:
    """(title, where it is from): the inventory's, the parser's unless it is a file name, the file's stem."""
    stem = PurePosixPath(path).stem
    reported = normalized(reported) or stem
    if normalized(inventory):
        return normalized(inventory), "inventory_title"
    return (stem, "filename_fallback") if filename_like(reported, path) else (reported, "parser_reported_title")


def document_row(path: str, content: bytes, parsed: Parsed, inventory: str | None = None) -> dict:
    """The document of a file with its blocks numbered in order."""
    kind, digest = format_of(path), hashlib.sha256(content).hexdigest()
    doc = f"doc_{kind}_{digest[:12]}"
    title, source = resolved_title(parsed.title, inventory, path)
    blocks = []
    for item in parsed.items:
        table = None
        if item.rows is not None:
            table = table_of(item.rows, item.caption)
        order = len(blocks) + 1
        number = order if item.number is None else item.number
        image = None
        if item.image is not None:
            image = {"image_id": f"img_{order:04d}", "caption": None, "ocr_text": None, "image_path": None, "width": None, "height": None} | item.image
        blocks.append({
            "block_id": "_".join(x for x in (doc, item.where, item.kind, f"{number:04d}") if x), "block_type": item.block_type, "text": item.text, "table_data": table, "image": image,
            "page_start": item.page, "page_end": item.page, "bbox": item.box, "heading_path": [], "heading_level": item.level, "page_height": item.page_height,
            "ocr_decision": None if item.image is None else "review_before_ocr" if item.code else "skip_ocr", "ocr_reason_codes": [item.code] if item.code else [],
            "raw_object_type": item.raw_type, "raw_object_index": item.raw_index, "raw_locator": item.locator, "quality_flags": ["review_before_ocr"] if item.image is not None and item.code else [], "block_order": order,
        })
    meta = {k: str(v) for k, v in (parsed.metadata | VERSIONS | {"sha256": digest, "title_source": source}).items()}
    return {"path": path, "document_id": doc, "title": title, "file_type": kind, "metadata": meta, "blocks": blocks, "error_type": None, "error": None}
