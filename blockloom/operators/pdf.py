"""From words and their places on PDF pages to lines, paragraphs, captions, picture groups and page features.

Whatever finds words (an adapter) gives them as rows: document_id, page, text, x0, top, x1, bottom.  Everything here is
keyed by (document_id, page); a page's words are few, so folds over them run on one array per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.text import normalize_text

PADDING, TOLERANCE, WORD_GAP, PARAGRAPH_GAP, ABOVE = 2.0, 3.0, 3.0, 12.0, 80.0
HEADER_TOP, FOOTER, HEADER_LENGTH = 76.0, 80.0, 40
OVERLAP, PICTURE_GAP = 0.7, 4.0
PAGE = ["document_id", "page"]
_TOKEN = r"[A-Za-z0-9%./()+-]"
#: Words that make a short line without punctuation a heading.
KEYWORDS = "附表|政策|办法|指南|公报|报告|概况"


def words_outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in no table box of their page (boxes padded by 2)."""
    b = boxes.select(*(F.col(c).alias(f"b_{c}") for c in PAGE), *(F.col(c).alias(f"b_{c}") for c in ("x0", "top", "x1", "bottom")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = x.between(F.col("b_x0") - PADDING, F.col("b_x1") + PADDING) & y.between(F.col("b_top") - PADDING, F.col("b_bottom") + PADDING)
    return words.join(b, (F.col("document_id") == F.col("b_document_id")) & (F.col("page") == F.col("b_page")) & inside, "left_anti")


def _glue(before: Column, after: Column) -> Column:
    return F.coalesce(before.rlike(_TOKEN + r"\z") | after.rlike(r"\A" + _TOKEN), F.lit(False))


def lines(words: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(document_id, page, line, text, x0, top, x1, bottom, word_count, is_header_footer).

    A word belongs to the line before if its top is within 3 of the mean top of that line's words so far."""
    w = F.struct("top", "x0", "x1", "bottom", normalize_text("text").alias("text"))
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(w)).alias("ws"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        same = (acc["n"] > 0) & (F.abs(x["top"] - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= TOLERANCE)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, acc["sum"] + x["top"]).otherwise(x["top"].cast("double")).alias("sum"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.concat(acc["at"], F.array(line)).alias("at"))

    placed = pages.withColumn("at", F.aggregate("ws", start, step)["at"])
    rows = placed.select(*PAGE, F.explode(F.arrays_zip("ws", "at")).alias("z")).select(*PAGE, F.col("z.at").alias("line"), "z.ws.*")
    per_line = rows.groupBy(*PAGE, "line").agg(
        F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("x0", "x1", "text")))).alias("ws"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("word_count")
    )
    spaced = F.transform("ws", lambda x, i: F.when((i > 0) & (x["x0"] - F.get("ws", i - 1)["x1"] > WORD_GAP) & _glue(F.get("ws", i - 1)["text"], x["text"]), F.concat(F.lit(" "), x["text"])).otherwise(x["text"]))
    out = per_line.withColumn("text", normalize_text(F.array_join(spaced, ""))).where("text <> ''").drop("ws")
    if heights is not None:
        out = out.join(heights.select(*PAGE, "page_height"), PAGE, "left")
    else:
        out = out.withColumn("page_height", F.lit(None).cast("double"))
    return out.withColumn("is_header_footer", is_header_or_footer())


def is_header_or_footer() -> Column:
    """Short and near the top, or only digits near the bottom."""
    head = (F.col("top") < HEADER_TOP) & (F.length("text") <= HEADER_LENGTH)
    foot = (F.col("bottom") > F.col("page_height") - FOOTER) & F.col("text").rlike(r"(?U)\A\d+\z")
    return head | F.coalesce(foot, F.lit(False))


def line_class(text: Column | str = "text") -> Column:
    """struct(kind, level): skip, table_caption, figure_caption, table_note, heading or paragraph; the first that fits."""
    t = F.col(text) if isinstance(text, str) else text
    kind = lambda k, level=None: F.struct(F.lit(k).alias("kind"), F.lit(level).cast("int").alias("level"))
    short = (F.length(t) <= 30) & ~t.rlike("[，。；：,.;:《》]") & t.rlike(KEYWORDS)
    return (
        F.when(t == "目录", kind("skip")).when(t.rlike(r"(?U)^表\s*\d+\s*[-－]\s*\d+"), kind("table_caption")).when(t.rlike(r"(?U)^图\s*\d+\s*[-－]\s*\d+"), kind("figure_caption")).when(t.rlike("^单位[:：]"), kind("table_note"))
        .when(t.rlike("^[（(]?[一二三四五六七八九十]+[）)、.．]"), kind("heading", 2)).when(t.rlike("^第[一二三四五六七八九十0-9]+[章节]"), kind("heading", 1)).when(short, kind("heading", 1)).otherwise(kind("paragraph"))
    )


def paragraphs(text_lines: DataFrame) -> DataFrame:
    """(document_id, page, first_line, block_type, heading_level, text, bbox): lines joined to paragraphs, others alone.

    Headers, footers and 目录 are passed over; a paragraph ends at a gap above 12, after the end of a sentence, and at any
    other kind of line.  Joining removes a hyphen at the end, else puts a space beside Latin signs."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    rows = text_lines.where("not is_header_footer").withColumn("c", line_class()).where("c.kind <> 'skip'")
    lag = lambda c: F.lag(c).over(w)
    joins = (F.col("c.kind") == "paragraph") & (lag("c.kind") == "paragraph") & (F.col("top") - lag("bottom") <= PARAGRAPH_GAP) & ~lag("text").rlike("[。！？.!?]$")
    rows = rows.withColumn("g", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*PAGE, "g").agg(
        F.min("line").alias("first_line"), F.first("c.kind").alias("block_type"), F.first("c.level").alias("heading_level"), F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]).alias("ts"), union_box().alias("bbox")
    )
    step = lambda a, x: F.when(a == "", x).when(a.rlike("[-－]$"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), x)).when(_glue(a, x), F.concat(a, F.lit(" "), x)).otherwise(F.concat(a, x))
    return parts.withColumn("text", normalize_text(F.aggregate("ts", F.lit(""), step))).drop("ts", "g")


def union_box() -> Column:
    """The box around all boxes of a group."""
    return F.array(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom"))


def table_context(tables: DataFrame, text_lines: DataFrame) -> DataFrame:
    """tables (document_id, page, table_id, x0, top, x1, bottom) with the last caption and all notes of the lines up to 80 above."""
    near = text_lines.where("not is_header_footer").select(*PAGE, "line", F.col("text").alias("line_text"), F.col("bottom").alias("line_bottom")).withColumn("kind", line_class(F.col("line_text"))["kind"]).where(F.col("kind").isin("table_caption", "table_note"))
    t = tables.select(*PAGE, "table_id", "top")
    hit = t.join(near, PAGE).where((F.col("top") - F.col("line_bottom")).between(0, ABOVE))
    got = hit.groupBy(*PAGE, "table_id").agg(
        F.max_by("line_text", F.when(F.col("kind") == "table_caption", F.col("line"))).alias("caption"), F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "table_note", F.struct("line", "line_text")))), lambda s: s["line_text"]).alias("notes")
    )
    return tables.join(got, [*PAGE, "table_id"], "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def group_pictures(pictures: DataFrame) -> DataFrame:
    """(document_id, page, bbox, n): pictures one below the other are one, as they are met from top to bottom."""
    box = F.struct("top", "x0", "x1", "bottom")
    pages = pictures.groupBy(*PAGE).agg(F.sort_array(F.collect_list(box)).alias("ps"))
    empty = F.array().cast("array<struct<x0:double,top:double,x1:double,bottom:double,n:int>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        common = F.least(last["x1"], p["x1"]) - F.greatest(last["x0"], p["x0"])
        narrow = F.least(last["x1"] - last["x0"], p["x1"] - p["x0"])
        join = (F.size(acc) > 0) & (narrow > 0) & (common / F.when(narrow > 0, narrow) >= OVERLAP) & (p["top"] - last["bottom"] <= PICTURE_GAP)
        both = F.struct(F.least(last["x0"], p["x0"]).alias("x0"), F.least(last["top"], p["top"]).alias("top"), F.greatest(last["x1"], p["x1"]).alias("x1"), F.greatest(last["bottom"], p["bottom"]).alias("bottom"), (last["n"] + 1).alias("n"))
        own = F.struct(p["x0"].alias("x0"), p["top"].alias("top"), p["x1"].alias("x1"), p["bottom"].alias("bottom"), F.lit(1).alias("n"))
        return F.when(F.coalesce(join, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(own)))

    groups = pages.select(*PAGE, F.explode(F.aggregate("ps", empty, step)).alias("g"))
    return groups.select(*PAGE, F.array("g.x0", "g.top", "g.x1", "g.bottom").alias("bbox"), F.col("g.n").alias("n"))


def page_features(text: str = "text", cells: str = "cells", image_ratios: str = "image_ratios", word_count: str = "word_count") -> list[Column]:
    """Columns that judge a page: its text, the cells of its tables, the share of the page that each picture takes."""
    t, c = normalize_text(text), F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda x: normalize_text(x))
    cid, lost = F.regexp_count(t, F.lit(r"(?i)\(cid:\d+\)")), F.length(t) - F.length(F.regexp_replace(t, "�", ""))
    ratios = F.coalesce(image_ratios, F.array().cast("array<double>"))
    return [
        F.length(t).alias("text_length"), F.col(word_count).alias("word_count"), F.size(ratios).alias("image_count"), F.coalesce(F.array_max(ratios), F.lit(0.0)).alias("max_image_area_ratio"), cid.alias("cid_count"), lost.alias("replacement_count"),
        F.round((cid + lost) / F.greatest(F.length(t), F.lit(1)), 6).alias("garbled_ratio"), F.size(c).alias("table_cell_count"), F.round(F.size(F.filter(c, lambda x: x == "")) / F.greatest(F.size(c), F.lit(1)), 6).alias("table_empty_ratio"),
        F.size(F.filter(c, lambda x: x.rlike(r"\A[-+]?\d+(?:\.\d+)?%?\z"))).alias("table_numeric_count"),
    ]


def cover_title(title: Column | str, first_heading: Column | str) -> Column:
    """The first heading of page 1 in place of a title that tools write."""
    t = F.col(title) if isinstance(title, str) else title
    h = F.col(first_heading) if isinstance(first_heading, str) else first_heading
    low = F.lower(normalize_text(t))
    noisy = low.startswith("microsoft word") | low.rlike(r"\.(doc|docx|pdf)\z") | low.isin("untitled", "document", "")
    return F.when(noisy & h.isNotNull(), h).otherwise(t)
