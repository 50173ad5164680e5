"""Queries of page geometry, OCR policies and layouts, over words and layouts made from the blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.operators import ocr, pdf
from blockloom.queries.text import B, blocks, documents, sql_collapse, sql_norm
from blockloom.sources import files


def _boxes(spark, sf):
    """Blocks with places as words of their pages."""
    b = blocks(spark, sf).where("size(bbox) = 4 and page_start is not null and text is not null and text <> ''")
    return b.select("document_id", F.col("page_start").alias("page"), "block_id", "block_type", "text", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("top"), F.col("bbox")[2].alias("x1"), F.col("bbox")[3].alias("bottom"), "page_height", "block_order")


def words_outside_tables(spark, sf):
    """Blocks whose centre is in no heading's box of their page."""
    w = _boxes(spark, sf)
    return pdf.words_outside(w, w.where("block_type = 'heading'")).select("block_id")


def _lines(spark, sf):
    """Blocks as lines, numbered by their order."""
    n = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("block_order", "block_id"))
    return _boxes(spark, sf).withColumn("line", n).withColumn("is_header_footer", pdf.is_header_or_footer())


def header_footer(spark, sf):
    return _lines(spark, sf).select("block_id", "is_header_footer")


def page_paragraphs(spark, sf):
    out = pdf.paragraphs(_lines(spark, sf))
    return out.select("document_id", F.col("page").cast("bigint").alias("page"), F.col("first_line").cast("bigint").alias("first_line"), "block_type")


def page_boxes(spark, sf):
    out = _boxes(spark, sf).groupBy("document_id", "page").agg(pdf.union_box().alias("b"))
    return out.select("document_id", F.col("page").cast("bigint").alias("page"), *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))))


def page_lines(spark, sf):
    """Words of every line gathered to lines again."""
    w = _boxes(spark, sf).select("document_id", "page", "x0", "top", "x1", "bottom", "text")
    return pdf.lines(w).select("document_id", F.col("page").cast("bigint").alias("page"), F.col("line").cast("bigint").alias("line"), F.col("word_count").cast("bigint").alias("word_count"))


def table_contexts(spark, sf):
    rows = _lines(spark, sf)
    said = F.when(F.col("line") % 3 == 0, F.concat(F.lit("表 1-"), F.col("line"))).when(F.col("line") % 3 == 1, F.concat(F.lit("单位："), F.col("line"))).otherwise(F.col("text"))
    tables = rows.where("block_type = 'heading'").select("document_id", "page", F.col("block_id").alias("table_id"), "x0", "top", "x1", "bottom")
    out = pdf.table_context(tables, rows.withColumn("text", said))
    return out.select("table_id", "caption", F.array_join("notes", ",").alias("notes"))


def _features(spark, sf):
    b = blocks(spark, sf).where("page_start is not null")
    pages = b.groupBy("document_id", F.col("page_start").alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", "block_id", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), " ").alias("text"), F.count("*").alias("word_count"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("block_type") == "heading", F.struct("block_order", "block_id", (F.col("block_order") / 20.0).cast("double").alias("r"))))), lambda s: s["r"]).alias("image_ratios"),
    )
    cells = F.transform(F.sequence(F.lit(1), F.greatest("page", F.lit(1))), lambda i: F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(i.cast("string"), F.lit("%"))))
    return pages.withColumn("cells", cells).select("document_id", "page", F.when(F.col("page") > 1, 1).otherwise(0).alias("table_count"), *pdf.page_features())


def page_features(spark, sf):
    f = _features(spark, sf)
    ints = ("text_length", "word_count", "image_count", "cid_count", "replacement_count", "table_cell_count", "table_numeric_count")
    return f.select("document_id", F.col("page").cast("bigint").alias("page"), *(F.col(c).cast("bigint").alias(c) for c in ints), "max_image_area_ratio", "garbled_ratio", "table_empty_ratio")


def ocr_page_policy(spark, sf):
    return _features(spark, sf).withColumn("d", ocr.page_decision()).select("document_id", F.col("page").cast("bigint").alias("page"), "d.decision", "d.confidence", "d.reason_code")


def ocr_image_policy(spark, sf):
    return blocks(spark, sf).where("block_type = 'image'").withColumn("d", ocr.image_decision()).select("block_id", "d.decision", "d.reason_code")


def ocr_candidates(spark, sf):
    return ocr.candidates(blocks(spark, sf)).select("candidate_id", "block_id", "reason_code")


def _layouts(spark, sf):
    """Blocks as an OCR layout of their page."""
    k = F.col("block_order") % 6
    kind = F.when(F.col("block_type") == "heading", "paragraph_title").when(k == 0, "table").when(k == 1, "figure_title").when(k == 2, "vision_footnote").when(k == 3, "image").when(k == 4, "number").otherwise("text")
    text = F.when(k == 1, F.concat(F.when(F.col("block_order") % 4 == 1, "表").otherwise("图"), F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    box = F.when(F.size("bbox") == 4, F.array(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1]))
    return blocks(spark, sf).where("page_start is not null").select("document_id", (F.col("page_start") - 1).alias("page_num"), F.col("block_order").alias("pos"), F.col("block_id").alias("layout_id"), kind.alias("type"), text.alias("text"), box.alias("position"))


def layout_neighbours(spark, sf):
    return ocr.layout_neighbours(_layouts(spark, sf)).where("target_id is not null").select("layout_id", "target_id", "role")


def layout_blocks(spark, sf):
    lay = _layouts(spark, sf)
    tables = lay.where("type = 'table'").select("document_id", "layout_id", F.lit(1).alias("idx"), F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(-1), F.lit(9))).alias("matrix"), F.array(F.lit("a"), F.col("layout_id")).alias("cells"), F.lit("").alias("markdown"))
    images = lay.where("type = 'image'").select("document_id", "layout_id", F.lit(1).alias("idx"), F.lit(" seen ").alias("image_description"))
    out = ocr.layout_blocks(lay, tables, images)
    return out.select("layout_id", "block_type", "text", F.col("block_order").cast("bigint").alias("block_order"), "excluded_from_retrieval", F.array_join("table_data.headers", "|").alias("headers"), F.array_join(F.flatten("table_data.rows"), "|").alias("rows"), F.col("table_data.caption").alias("caption"), F.col("image.ocr_text").alias("ocr_text"))


def parsed_markdown(spark, sf):
    """Every document written as a Markdown file and read again."""
    b = blocks(spark, sf).where("text is not null")
    line = F.when(F.col("block_type") == "heading", F.concat(F.lit("## "), F.regexp_replace("text", r"\n", " "))).otherwise(F.concat(F.lit("\n"), F.col("text"), F.lit("\n")))
    whole = b.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", "block_id", line.alias("t")))), lambda s: s["t"]), "\n").alias("md"))
    parsed = files.parse(whole.select(F.concat(F.lit("/in/"), "document_id", F.lit(".md")).alias("path"), F.encode("md", "UTF-8").alias("content")))
    return files.blocks(parsed).select("document_id", "block_id", "block_type", "text")


def parsed_html(spark, sf):
    """Every web document written as an HTML file and read again."""
    b = blocks(spark, sf).where("text is not null").join(documents(spark, sf).where("file_type = 'html'").select("document_id"), "document_id")
    tag = F.when(F.col("block_type") == "heading", "h2").when(F.col("block_type") == "list_item", "li").when(F.col("block_type") == "code", "pre").otherwise("p")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    whole = b.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", "block_id", part.alias("t")))), lambda s: s["t"]), "").alias("body"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav>"), "body", F.lit("</body></html>"))
    parsed = files.parse(whole.select(F.concat(F.lit("/in/"), "document_id", F.lit(".html")).alias("path"), F.encode(page, "UTF-8").alias("content")))
    out = files.blocks(parsed).groupBy("block_type").agg(F.count("*").alias("n"))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        words_outside_tables, header_footer, page_paragraphs, page_boxes, page_lines, table_contexts, page_features, ocr_page_policy, ocr_image_policy, ocr_candidates, layout_neighbours, layout_blocks, parsed_markdown, parsed_html,
    )
}

_W = "w AS (SELECT document_id, page_start AS page, block_id, block_type, text, bbox[1] AS x0, bbox[2] AS top, bbox[3] AS x1, bbox[4] AS bottom, page_height, block_order FROM b WHERE len(bbox) = 4 AND page_start IS NOT NULL AND text IS NOT NULL AND text <> '')"
_LN = f"ln AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY block_order, block_id) AS line, (top < 76 AND length(text) <= 40) OR coalesce(bottom > page_height - 80 AND regexp_matches(text, '^\\d+$'), false) AS hf FROM w)"
_CLASS = r"""CASE WHEN t = '目录' THEN 'skip' WHEN regexp_matches(t, '^表\s*\d+\s*[-－]\s*\d+') THEN 'table_caption' WHEN regexp_matches(t, '^图\s*\d+\s*[-－]\s*\d+') THEN 'figure_caption' WHEN regexp_matches(t, '^单位[:：]') THEN 'table_note'
    WHEN regexp_matches(t, '^[（(]?[一二三四五六七八九十]+[）)、.．]') OR regexp_matches(t, '^第[一二三四五六七八九十0-9]+[章节]') OR (length(t) <= 30 AND NOT regexp_matches(t, '[，。；：,.;:《》]') AND regexp_matches(t, '附表|政策|办法|指南|公报|报告|概况')) THEN 'heading' ELSE 'paragraph' END"""
_FEAT = f"""pg AS (SELECT document_id, page_start AS page, {sql_norm("string_agg(coalesce(text, ''), ' ' ORDER BY block_order, block_id)")} AS t, count(*) AS word_count, coalesce(max(block_order / 20.0) FILTER (block_type = 'heading'), 0) AS mr, count(*) FILTER (block_type = 'heading') AS ic FROM b WHERE page_start IS NOT NULL GROUP BY 1, 2),
    ft AS (SELECT document_id, page, CASE WHEN page > 1 THEN 1 ELSE 0 END AS table_count, length(t) AS text_length, word_count, ic AS image_count, mr::DOUBLE AS max_image_area_ratio, len(regexp_extract_all(t, '(?i)\\(cid:\\d+\\)')) AS cid_count, length(t) - length(replace(t, chr(65533), '')) AS replacement_count,
        round((len(regexp_extract_all(t, '(?i)\\(cid:\\d+\\)')) + length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1), 6) AS garbled_ratio, greatest(page, 1) AS table_cell_count, round((greatest(page, 1) // 2) / greatest(page, 1), 6) AS table_empty_ratio, greatest(page, 1) - greatest(page, 1) // 2 AS table_numeric_count FROM pg)"""
_LAY = """ly AS (SELECT document_id, page_start - 1 AS page_num, block_order AS pos, block_id AS layout_id, CASE WHEN block_type = 'heading' THEN 'paragraph_title' WHEN block_order % 6 = 0 THEN 'table' WHEN block_order % 6 = 1 THEN 'figure_title' WHEN block_order % 6 = 2 THEN 'vision_footnote' WHEN block_order % 6 = 3 THEN 'image'
    WHEN block_order % 6 = 4 THEN 'number' ELSE 'text' END AS type, CASE WHEN block_order % 6 = 1 THEN (CASE WHEN block_order % 4 = 1 THEN '表' ELSE '图' END) || ' ' || coalesce(text, '') ELSE text END AS text FROM b WHERE page_start IS NOT NULL)"""


def _near(types: str, fn: str, most: int) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {fn}(type, {d}) OVER v IN {types} THEN {fn}(layout_id, {d}) OVER v END" for d in range(1, most + 1)) + ")"


_NB = f"""nb AS (SELECT *, CASE WHEN type = 'figure_title' AND starts_with(txt, '表') THEN {_near("('table')", 'lead', 3)} END AS tc, CASE WHEN type = 'figure_title' AND starts_with(txt, '图') THEN {_near("('image', 'chart')", 'lag', 3)} END AS fc,
    CASE WHEN type = 'vision_footnote' THEN coalesce({_near("('table')", 'lead', 2)}, {_near("('table')", 'lag', 2)}) END AS tn FROM (SELECT *, {sql_collapse('text')} AS txt FROM ly) WINDOW v AS (PARTITION BY document_id, page_num ORDER BY pos)),
    nr AS (SELECT *, coalesce(tc, fc, tn) AS target_id, CASE WHEN tc IS NOT NULL THEN 'table_caption' WHEN fc IS NOT NULL THEN 'figure_caption' WHEN tn IS NOT NULL THEN 'table_note' END AS role FROM nb)"""

_IMAGE = """CASE WHEN image IS NULL THEN 'NO_IMAGE_DATA' WHEN trim(ocr_decision) = 'skip_ocr' THEN 'PARSER_DECLARED_SKIP' WHEN regexp_matches(lower(regexp_extract(coalesce(image.image_path, ''), '([^/\\\\]*)$', 1)), 'logo|icon|avatar|button|btn|qrcode|qr_code|spacer|banner') THEN 'DECORATIVE_IMAGE_NAME'
    WHEN coalesce(image.width > 0 AND image.height > 0 AND (least(image.width, image.height) <= 80 OR image.width * image.height <= 16384), false) THEN 'SMALL_DECORATIVE_IMAGE' ELSE 'CONTENT_IMAGE_REVIEW' END"""

ORACLE_SQL = {
    "words_outside_tables": f"""WITH {B}, {_W} SELECT block_id FROM w WHERE NOT EXISTS (SELECT 1 FROM w h WHERE h.block_type = 'heading' AND h.document_id = w.document_id AND h.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN h.x0 - 2 AND h.x1 + 2 AND (w.top + w.bottom) / 2 BETWEEN h.top - 2 AND h.bottom + 2)""",
    "header_footer": f"WITH {B}, {_W}, {_LN} SELECT block_id, hf AS is_header_footer FROM ln",
    "page_paragraphs": f"""WITH {B}, {_W}, {_LN}, c AS (SELECT * FROM (SELECT *, {_CLASS.replace(' t ', ' text ').replace('(t,', '(text,').replace('(t)', '(text)')} AS kind FROM ln WHERE NOT hf) WHERE kind <> 'skip'),
        j AS (SELECT *, coalesce(kind = 'paragraph' AND lag(kind) OVER v = 'paragraph' AND top - lag(bottom) OVER v <= 12 AND NOT regexp_matches(lag(text) OVER v, '[。！？.!?]$'), false) AS joins FROM c WINDOW v AS (PARTITION BY document_id, page ORDER BY line)),
        g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, page ORDER BY line) AS g FROM j)
        SELECT document_id, page::BIGINT AS page, min(line)::BIGINT AS first_line, any_value(kind) AS block_type FROM g GROUP BY document_id, page, g""",
    "page_boxes": f"WITH {B}, {_W} SELECT document_id, page::BIGINT AS page, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM w GROUP BY 1, 2",
    "table_contexts": f"""WITH {B}, {_W}, {_LN}, s AS (SELECT * REPLACE (CASE WHEN line % 3 = 0 THEN '表 1-' || line WHEN line % 3 = 1 THEN '单位：' || line ELSE text END AS text) FROM ln), k AS (SELECT * FROM (SELECT *, {_CLASS.replace(' t ', ' text ').replace('(t,', '(text,').replace('(t)', '(text)')} AS kind FROM s WHERE NOT hf) WHERE kind IN ('table_caption', 'table_note')),
        h AS (SELECT w.block_id AS table_id, k.line, k.text, k.kind FROM w LEFT JOIN k ON k.document_id = w.document_id AND k.page = w.page AND w.top - k.bottom BETWEEN 0 AND 80 WHERE w.block_type = 'heading')
        SELECT table_id, arg_max(text, line) FILTER (kind = 'table_caption') AS caption, coalesce(string_agg(text, ',' ORDER BY line) FILTER (kind = 'table_note'), '') AS notes FROM h GROUP BY 1""",
    "page_features": f"WITH {B}, {_FEAT} SELECT document_id, page::BIGINT AS page, text_length::BIGINT AS text_length, word_count, image_count, cid_count::BIGINT AS cid_count, replacement_count::BIGINT AS replacement_count, table_cell_count::BIGINT AS table_cell_count, table_numeric_count::BIGINT AS table_numeric_count, max_image_area_ratio, garbled_ratio, table_empty_ratio FROM ft",
    "ocr_page_policy": f"""WITH {B}, {_FEAT}, c AS (SELECT document_id, page, CASE WHEN text_length = 0 AND image_count = 0 AND table_count = 0 THEN 'BLANK_PAGE' WHEN cid_count >= 3 OR garbled_ratio >= 0.08 THEN 'NATIVE_TEXT_GARBLED' WHEN text_length <= 30 AND word_count <= 6 AND max_image_area_ratio >= 0.60 THEN 'SCANNED_PAGE'
        WHEN table_count > 0 AND table_empty_ratio >= 0.45 THEN 'NATIVE_TABLE_LOW_QUALITY' WHEN text_length < 100 AND image_count > 0 AND max_image_area_ratio >= 0.20 THEN 'MIXED_PAGE_LOW_TEXT' ELSE 'NATIVE_PARSE_USABLE' END AS reason_code FROM ft)
        SELECT document_id, page::BIGINT AS page, CASE reason_code WHEN 'BLANK_PAGE' THEN 'skip_ocr' WHEN 'NATIVE_TEXT_GARBLED' THEN 'auto_ocr' WHEN 'SCANNED_PAGE' THEN 'auto_ocr' WHEN 'NATIVE_PARSE_USABLE' THEN 'skip_ocr' ELSE 'review_before_ocr' END AS decision,
        CASE reason_code WHEN 'BLANK_PAGE' THEN 0.98 WHEN 'NATIVE_TEXT_GARBLED' THEN 0.95 WHEN 'SCANNED_PAGE' THEN 0.96 WHEN 'NATIVE_TABLE_LOW_QUALITY' THEN 0.75 WHEN 'MIXED_PAGE_LOW_TEXT' THEN 0.70 ELSE 0.92 END::DOUBLE AS confidence, reason_code FROM c""",
    "ocr_image_policy": f"WITH {B}, c AS (SELECT block_id, {_IMAGE} AS reason_code FROM b WHERE block_type = 'image') SELECT block_id, CASE WHEN reason_code = 'CONTENT_IMAGE_REVIEW' THEN 'review_before_ocr' ELSE 'skip_ocr' END AS decision, reason_code FROM c",
    "ocr_candidates": f"WITH {B}, c AS (SELECT block_id, {_IMAGE} AS reason_code FROM b WHERE block_type = 'image') SELECT 'img_' || substr(sha1(block_id), 1, 12) AS candidate_id, block_id, reason_code FROM c WHERE reason_code = 'CONTENT_IMAGE_REVIEW'",
    "layout_neighbours": f"WITH {B}, {_LAY}, {_NB} SELECT layout_id, target_id, role FROM nr WHERE target_id IS NOT NULL",
    "layout_blocks": f"""WITH {B}, {_LAY}, {_NB}, ab AS (SELECT document_id, target_id AS layout_id, arg_max(txt, pos) FILTER (role IN ('table_caption', 'figure_caption')) AS caption FROM nr WHERE target_id IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT nr.*, ab.caption, CASE WHEN type = 'paragraph_title' THEN 'heading' WHEN type = 'table' THEN 'table' WHEN type = 'image' THEN 'image' WHEN type = 'figure_title' AND coalesce(role, '') = 'table_caption' THEN 'table_caption' WHEN type = 'figure_title' THEN 'figure_caption'
            WHEN type = 'vision_footnote' AND regexp_matches(txt, '^(单位|注)') THEN 'table_note' ELSE 'paragraph' END AS block_type FROM nr LEFT JOIN ab USING (document_id, layout_id)),
        z AS (SELECT * FROM k WHERE block_type IN ('table', 'image') OR txt <> '')
        SELECT layout_id, block_type, CASE WHEN block_type NOT IN ('table', 'image') THEN txt END AS text, row_number() OVER (PARTITION BY document_id ORDER BY page_num, pos)::BIGINT AS block_order, type = 'number' AS excluded_from_retrieval,
            CASE WHEN block_type = 'table' THEN 'a|' || layout_id END AS headers, CASE WHEN block_type = 'table' THEN layout_id || '|' END AS rows, CASE WHEN block_type = 'table' THEN caption END AS caption, CASE WHEN block_type = 'image' THEN 'seen' END AS ocr_text FROM z""",
}
