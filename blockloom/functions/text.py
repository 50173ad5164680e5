"""Text functions as Spark columns: one home for every regular-expression dialect difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
#: What file names titles are made of, and lines a document doesn't need.
NOISE_TEXTS = ("首页", "政务公开", "互动交流", "网站地图", "友情链接", "版权声明")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(x), _EDGES, "")


def normalize_text(x: Column | str) -> Column:
    """One space for blanks of one line, at most one empty line, no blanks at the ends; null is ''."""
    t = F.translate(F.coalesce(col(x), F.lit("")), "　", " ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def compact(x: Column | str) -> Column:
    """Normalised, with every run of white space as one space."""
    return F.regexp_replace(normalize_text(x), r"(?U)[\s\x1c-\x1f]+", " ")


def collapse(x: Column | str) -> Column:
    """Words with single spaces between; null is ''."""
    return strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def _padded(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)).cast("int")))


def table_from_rows(rows: Column | str, caption: Column | None = None) -> Column:
    """struct(caption, headers, rows, notes): cells normalised, rows without any text left out, short rows filled up,
    the first row as headers.  Null and empty give empty lists."""
    cells = F.transform(F.coalesce(col(rows), F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: normalize_text(c)))
    kept = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0))
    full = F.transform(kept, lambda r: _padded(r, width))
    none = F.array().cast("array<string>")
    return F.struct(
        (F.lit(None).cast("string") if caption is None else caption).alias("caption"),
        F.coalesce(F.try_element_at(full, F.lit(1)), none).alias("headers"),
        F.when(F.size(full) > 1, F.slice(full, F.lit(2), F.size(full))).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
        none.alias("notes"),
    )


def table_to_markdown(table: Column | str) -> Column:
    """A pipe table as wide as its widest row: the headers, or without any the first row, a rule, the rows; '' for null and for no rows."""
    t = col(table)
    heads = F.coalesce(t["headers"], F.array().cast("array<string>"))
    rows = F.coalesce(t["rows"], F.array().cast("array<array<string>>"))
    every = F.when(F.size(heads) > 0, F.concat(F.array(heads), rows)).otherwise(rows)
    width = F.coalesce(F.array_max(F.transform(every, lambda r: F.size(r))), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(_padded(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(every, line)
    return F.when(t.isNull() | (F.size(every) == 0), "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))), "\n"))


def row_to_labeled_text(headers: Column | str, row: Column | str) -> Column:
    """``head: cell`` of each column that has either, joined by ；; beyond the headers a head is 列 and its number; an empty head leaves the cell."""
    h, r = F.coalesce(col(headers), F.array().cast("array<string>")), F.coalesce(col(row), F.array().cast("array<string>"))
    at = F.when(F.greatest(F.size(h), F.size(r)) > 0, F.sequence(F.lit(0), F.greatest(F.size(h), F.size(r), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    head = lambda i: F.when(i >= F.size(h), F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(normalize_text(F.get(h, i)))
    pairs = F.transform(at, lambda i: F.struct(head(i).alias("h"), normalize_text(F.get(r, i)).alias("c")))
    kept = F.filter(pairs, lambda p: (p["h"] != "") | (p["c"] != ""))
    return F.array_join(F.transform(kept, lambda p: F.when(p["h"] == "", p["c"]).otherwise(F.concat(p["h"], F.lit(": "), p["c"]))), "；")


def main_text(block_type: Column | str, text: Column | str, table: Column | str, image: Column | str) -> Column:
    """What a block says: its table as a pipe table, its image's text or caption, or its text."""
    kind, img = col(block_type), col(image)
    some = lambda x: F.when(x != "", x)
    return F.when((kind == "table") & col(table).isNotNull(), table_to_markdown(table)).when((kind == "image") & img.isNotNull(), normalize_text(F.coalesce(some(img["ocr_text"]), some(img["caption"])))).otherwise(normalize_text(text))


def context_prefix(title: Column | str, city: Column, category: Column, year: Column, heading_path: Column | str) -> Column:
    """Labelled context (文档, 城市, 类别, 年份, 章节), what is empty left out, joined by 。"""
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label + "："), x))
    steps = F.coalesce(col(heading_path), F.array().cast("array<string>"))
    path = F.when(F.size(steps) > 0, F.concat(F.lit("章节："), F.array_join(F.transform(steps, lambda x: F.coalesce(x, F.lit(""))), " > ")))
    return F.concat_ws("。", part("文档", col(title)), part("城市", city), part("类别", category), part("年份", year), path)


def preview(text: Column | str, table: Column | str, image: Column | str, length: int = 240) -> Column:
    """At most so many signs of a block for a reviewer."""
    t, tab, img = col(text), col(table), col(image)
    some = lambda x: F.when(x != "", x)
    heads = F.array_join(F.transform(tab["headers"], lambda h: F.coalesce(h, F.lit(""))), " | ")
    shown = F.when(F.coalesce(t, F.lit("")) != "", collapse(t)).when(tab.isNotNull(), heads).when(img.isNotNull(), F.coalesce(some(img["caption"]), some(img["ocr_text"]), F.lit("[image]"))).otherwise("")
    return F.substring(shown, 1, length)


def redact_urls(x: Column | str) -> Column:
    """Links without what follows the question mark, where a signature may stand; a link without a query stays."""
    return F.regexp_replace(col(x), r"""(https?://[^\s"'<>?#]+)\?[^\s"'<>#][^\s"'<>]*""", "$1")


def listed_ids(x: Column | str) -> Column:
    """Ids from a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), ","), lambda v: strip(v)), lambda v: v != "")


def dimension(x: Column | str) -> Column:
    """A number of pixels, with or without px; null if it is none."""
    return F.regexp_replace(strip(x), r"px\z", "").try_cast("double")


def xyxy(x: Column | str) -> Column:
    """[x, y, width, height] to [left, top, right, bottom]; null unless there are four numbers."""
    p = col(x)
    return F.when(F.size(p) == 4, F.array(p[0], p[1], p[0] + p[2], p[1] + p[3]))


def safe_stem(x: Column | str) -> Column:
    """A name for folders: letters, digits, - and ideographs kept, other runs one _, at most 80 signs, never empty."""
    t = F.regexp_replace(F.regexp_replace(col(x), "[^A-Za-z0-9_一-鿿-]+", "_"), "_+", "_")
    t = F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, 80)
    return F.when(F.coalesce(t, F.lit("")) == "", "file").otherwise(t)


def document_id(file_type: Column | str, content_sha256: Column | str) -> Column:
    return F.concat(F.lit("doc_"), col(file_type), F.lit("_"), F.substring(col(content_sha256), 1, 12))


def short_sha1(*parts: Column, prefix: str = "", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length))
