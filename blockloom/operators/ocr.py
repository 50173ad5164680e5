"""When a page or an image needs OCR, and what an OCR layout becomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.text import collapse, xyxy

#: Names of pictures that only decorate.
DECORATIVE = "logo|icon|avatar|button|btn|qrcode|qr_code|spacer|banner"


@dataclass(frozen=True)
class PagePolicy:
    """Limits for pages. Fixed values."""

    scanned_chars: int = 30
    scanned_words: int = 6
    scanned_image_ratio: float = 0.60
    mixed_chars: int = 100
    mixed_image_ratio: float = 0.20
    garbled_ratio: float = 0.08
    cid_marks: int = 3
    empty_cells: float = 0.45


@dataclass(frozen=True)
class ImagePolicy:
    small_side: float = 80
    small_area: float = 16384


def _decision(decision: str, confidence: float | None, code: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(confidence).cast("double").alias("confidence"), F.lit(code).alias("reason_code"))


def page_decision(p: PagePolicy = PagePolicy()) -> Column:  # noqa: B008
    """struct(decision, confidence, reason_code) from text_length, word_count, table_count, image_count,
    max_image_area_ratio, garbled_ratio, cid_count, table_empty_ratio; the first that holds wins."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    blank = (n("text_length") == 0) & (n("image_count") == 0) & (n("table_count") == 0)
    garbled = (n("cid_count") >= p.cid_marks) | (n("garbled_ratio") >= p.garbled_ratio)
    scanned = (n("text_length") <= p.scanned_chars) & (n("word_count") <= p.scanned_words) & (n("max_image_area_ratio") >= p.scanned_image_ratio)
    table = (n("table_count") > 0) & (n("table_empty_ratio") >= p.empty_cells)
    mixed = (n("text_length") < p.mixed_chars) & (n("image_count") > 0) & (n("max_image_area_ratio") >= p.mixed_image_ratio)
    return (
        F.when(blank, _decision("skip_ocr", 0.98, "BLANK_PAGE")).when(garbled, _decision("auto_ocr", 0.95, "NATIVE_TEXT_GARBLED")).when(scanned, _decision("auto_ocr", 0.96, "SCANNED_PAGE"))
        .when(table, _decision("review_before_ocr", 0.75, "NATIVE_TABLE_LOW_QUALITY")).when(mixed, _decision("review_before_ocr", 0.70, "MIXED_PAGE_LOW_TEXT")).otherwise(_decision("skip_ocr", 0.92, "NATIVE_PARSE_USABLE"))
    )


def image_decision(p: ImagePolicy = ImagePolicy()) -> Column:  # noqa: B008
    """struct(decision, confidence, reason_code) from image (image_path, width, height) and ocr_decision; never auto_ocr."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col("image.image_path"), F.lit("")), r"([^/\\]*)$", 1))
    w, h = F.col("image.width"), F.col("image.height")
    small = (w > 0) & (h > 0) & ((F.least(w, h) <= p.small_side) | (w * h <= p.small_area))
    return (
        F.when(F.col("image").isNull(), _decision("skip_ocr", None, "NO_IMAGE_DATA")).when(F.trim("ocr_decision") == "skip_ocr", _decision("skip_ocr", None, "PARSER_DECLARED_SKIP"))
        .when(name.rlike(DECORATIVE), _decision("skip_ocr", None, "DECORATIVE_IMAGE_NAME")).when(F.coalesce(small, F.lit(False)), _decision("skip_ocr", None, "SMALL_DECORATIVE_IMAGE")).otherwise(_decision("review_before_ocr", None, "CONTENT_IMAGE_REVIEW"))
    )


def candidates(blocks: DataFrame, policy: ImagePolicy = ImagePolicy()) -> DataFrame:  # noqa: B008
    """Images that go to review before OCR, with their candidate ids."""
    d = image_decision(policy)
    rows = blocks.where("block_type = 'image'").withColumn("d", d).where(F.col("d.decision") != "skip_ocr")
    return rows.select(F.concat(F.lit("img_"), F.substring(F.sha1("block_id"), 1, 12)).alias("candidate_id"), "document_id", "block_id", F.col("page_start").alias("page_number"), "d.decision", "d.reason_code")


#: Fixed values of layouts: what is a heading, what is an image, what is left out of retrieval.
LAYOUT_HEADINGS = ("doc_title", "paragraph_title", "title")
LAYOUT_IMAGES = ("image", "chart", "seal", "footer_image", "header_image")
LAYOUT_EXCLUDED = ("content", "footer_image", "header_image", "number")


def layout_neighbours(layouts: DataFrame) -> DataFrame:
    """Adds target_id and role: the table or picture a title or note belongs to, by distance in reading order.

    A title that begins with 表 names the next table within three; with 图 the picture before within three; a footnote
    of the kind vision_footnote the next table within two, else the one before within two.
    """
    w = Window.partitionBy("document_id", "page_num").orderBy("pos")
    kind, text = F.col("type"), collapse("text")

    def near(types: tuple, back: bool, most: int) -> Column:
        at = F.lag if back else F.lead
        return F.coalesce(*(F.when(at("type", d).over(w).isin(*types), at("layout_id", d).over(w)) for d in range(1, most + 1)))

    table = F.when((kind == "figure_title") & text.startswith("表"), near(("table",), False, 3))
    picture = F.when((kind == "figure_title") & text.startswith("图"), near(("image", "chart"), True, 3))
    note = F.when(kind == "vision_footnote", F.coalesce(near(("table",), False, 2), near(("table",), True, 2)))
    role = F.when(table.isNotNull(), "table_caption").when(picture.isNotNull(), "figure_caption").when(note.isNotNull(), "table_note")
    return layouts.withColumn("target_id", F.coalesce(table, picture, note)).withColumn("role", role)


def layout_blocks(layouts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks of an OCR layout (document_id, page_num from 0, pos, layout_id, type, text, position [x, y, w, h]).

    tables: (document_id, layout_id, idx, matrix of cell indexes, cells, markdown); images: (document_id, layout_id, idx, image_description);
    of repeated ids the last wins, missing ones give empty data.  Empty texts give no block and use up no order.
    """
    last = lambda df, *c: df.groupBy("document_id", "layout_id").agg(F.max_by(F.struct(*c), "idx").alias("d")).select("document_id", "layout_id", "d.*")
    rows = layout_neighbours(layouts).join(last(tables, "matrix", "cells", "markdown"), ["document_id", "layout_id"], "left").join(last(images, "image_description"), ["document_id", "layout_id"], "left")
    about = layout_neighbours(layouts).where("target_id is not null").groupBy("document_id", "target_id").agg(
        F.max_by(collapse("text"), F.when(F.col("role").isin("table_caption", "figure_caption"), F.col("pos"))).alias("caption"), F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "table_note", F.struct("pos", collapse("text").alias("t"))))), lambda s: s["t"]).alias("notes")
    )
    rows = rows.join(about.withColumnRenamed("target_id", "layout_id"), ["document_id", "layout_id"], "left")
    kind = F.col("type")
    block_type = F.when(kind.isin(*LAYOUT_HEADINGS), "heading").when(kind == "table", "table").when(kind.isin(*LAYOUT_IMAGES), "image").when((kind == "figure_title") & (F.col("role") == "table_caption"), "table_caption").when(kind == "figure_title", "figure_caption").when((kind == "vision_footnote") & collapse("text").rlike("^(单位|注)"), "table_note").otherwise("paragraph")
    # A cell index that isn't there is '', a negative one counts from the end.
    cell = lambda i: F.coalesce(F.try_element_at("cells", F.when(i < 0, i).otherwise(i + 1).cast("int")), F.lit(""))
    matrix = F.transform(F.coalesce("matrix", F.array().cast("array<array<int>>")), lambda r: F.transform(r, cell))
    fallback = F.when((F.size(matrix) == 0) & (F.coalesce("markdown", F.lit("")) != ""), F.array("markdown")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    data = F.struct(
        F.col("caption"), F.coalesce(F.try_element_at(matrix, F.lit(1)), none).alias("headers"), F.when(F.size(matrix) > 1, F.slice(matrix, F.lit(2), F.size(matrix))).otherwise(F.array().cast("array<array<string>>")).alias("rows"), F.concat(F.coalesce("notes", none), fallback).alias("notes"),
    )
    image = F.struct(F.col("layout_id").alias("image_id"), F.col("caption").alias("caption"), F.when(F.trim("image_description") != "", F.trim("image_description")).alias("ocr_text"))
    out = rows.withColumn("block_type", block_type).withColumn("text", F.when(~F.col("block_type").isin("table", "image"), collapse("text")))
    out = out.where(F.col("block_type").isin("table", "image") | (F.col("text") != ""))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_num", "pos"))
    return out.select(
        "document_id", (F.col("page_num") + 1).alias("page_start"), order.alias("block_order"), "layout_id", "block_type", "text", F.when(F.col("block_type") == "table", data).alias("table_data"), F.when(F.col("block_type") == "image", image).alias("image"),
        xyxy("position").alias("bbox"), kind.isin(*LAYOUT_EXCLUDED).alias("excluded_from_retrieval"),
        F.when(kind.isin(*LAYOUT_EXCLUDED) & F.col("text").isNotNull(), F.array(F.lit("excluded_layout_noise"))).otherwise(none).alias("quality_flags"),
    )
