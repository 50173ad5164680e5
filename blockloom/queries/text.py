"""Queries of text functions, tables and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import text as X
from blockloom.operators import export, pdf
from blockloom.plans.pipeline import prepared
from blockloom.sources import assets, files
from blockloom.tables import table

#: Unicode white space for RE2, and its forms of the text rules.
_WS = r"\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def sql_norm(x: str) -> str:
    return sql_strip(rf"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(12288), ' '), '[ \t\r\f\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_collapse(x: str) -> str:
    return sql_strip(rf"regexp_replace(coalesce({x}, ''), '[{_WS}]+', ' ', 'g')")


#: Each block once.
B = "b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY received_at) AS rn FROM blocks) WHERE rn = 1)"
D = "d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY parsed_at, received_at, coalesce(title, ''), source_id) AS rn FROM parsed_documents) WHERE rn = 1)"


def blocks(spark, sf):
    return prepared(table(spark, sf, "blocks"))


def documents(spark, sf):
    """The first parse of each document."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("parsed_at", "received_at", F.coalesce("title", F.lit("")), "source_id")
    return table(spark, sf, "parsed_documents").withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text("text").alias("text"))


def compact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.compact("text").alias("text"))


def document_ids(spark, sf):
    sha = F.get_json_object("metadata", "$.sha256")
    return table(spark, sf, "source_files").select("source_id", X.document_id("file_type", sha).alias("document_id"), X.safe_stem(F.regexp_replace("original_filename", r"\.[^.]*$", "")).alias("stem"))


def file_types(spark, sf):
    return table(spark, sf, "source_files").select("source_id", files.file_type(F.col("file_path")).alias("detected"), F.col("file_type").alias("declared"))


def url_redaction(spark, sf):
    signed = F.concat_ws("", F.lit("see "), "source_url", F.lit("?token=abc&expires=9 and "), "source_url", F.lit("#part"))
    return table(spark, sf, "source_files").where("source_url <> ''").select("source_id", X.redact_urls(signed).alias("text"))


def table_from_rows(spark, sf):
    t = blocks(spark, sf).where("table_data is not null")
    made = X.table_from_rows(F.concat(F.array("table_data.headers"), "table_data.rows"))
    rows = t.select("block_id", made.alias("t"))
    return rows.select("block_id", F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").cast("bigint").alias("n_rows"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "/").alias("rows"))


def table_markdown(spark, sf):
    return blocks(spark, sf).where("table_data is not null").select("block_id", X.table_to_markdown("table_data").alias("markdown"))


def labeled_rows(spark, sf):
    rows = blocks(spark, sf).where("table_data is not null").select("block_id", "table_data.headers", F.posexplode("table_data.rows").alias("row", "cells"))
    return rows.select("block_id", F.col("row").cast("bigint").alias("row"), X.row_to_labeled_text("headers", "cells").alias("text"))


def main_text(spark, sf):
    return blocks(spark, sf).select("block_id", X.main_text("block_type", "text", "table_data", "image").alias("text"))


def block_preview(spark, sf):
    return blocks(spark, sf).select("block_id", X.preview("text", "table_data", "image").alias("preview"))


def context_prefix(spark, sf):
    d = documents(spark, sf).select("document_id", "title", "site", F.year("parsed_at").cast("string").alias("year"))
    rows = blocks(spark, sf).select("document_id", "block_id", "heading_path").join(d, "document_id")
    return rows.select("block_id", X.context_prefix("title", F.col("site"), F.lit(None).cast("string"), F.col("year"), "heading_path").alias("prefix"))


def line_classify(spark, sf):
    rows = blocks(spark, sf).where("text is not null").select("block_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("c", pdf.line_class())
    return rows.select("block_id", F.col("line").cast("bigint").alias("line"), F.col("c.kind").alias("kind"), F.col("c.level").cast("bigint").alias("level"))


def cover_title(spark, sf):
    first = blocks(spark, sf).where("block_type = 'heading' and page_start = 1 and text is not null").groupBy("document_id").agg(F.min_by("text", "block_order").alias("heading"))
    d = documents(spark, sf).join(first, "document_id", "left")
    return d.select("document_id", pdf.cover_title("title", "heading").alias("title"))


def asset_states(spark, sf):
    rows = blocks(spark, sf).where("block_type = 'image'").join(documents(spark, sf).select("document_id", "file_type"), "document_id").withColumn("raw_locator", F.col("source_trace.raw_locator"))
    return rows.select("block_id", assets.asset_state().alias("s")).select("block_id", "s.status", "s.reason_code")


def markdown_export(spark, sf):
    return export.document_markdown(blocks(spark, sf), documents(spark, sf))


QUERIES = {f.__name__: f for f in (normalize_text, compact_text, document_ids, file_types, url_redaction, table_from_rows, table_markdown, labeled_rows, main_text, block_preview, context_prefix, line_classify, cover_title, asset_states, markdown_export)}

_TABLE = "t AS (SELECT block_id, table_data.headers AS heads, table_data.rows AS rws FROM b WHERE table_data IS NOT NULL)"
_MD_TABLE = """CASE WHEN len(every) = 0 THEN '' ELSE array_to_string(list_concat(
    ['| ' || array_to_string(list_transform(range(wide), lambda i: coalesce(every[1][i + 1], '')), ' | ') || ' |', '| ' || array_to_string(list_transform(range(wide), lambda i: '---'), ' | ') || ' |'],
    list_transform(every[2:], lambda r: '| ' || array_to_string(list_transform(range(wide), lambda i: coalesce(r[i + 1], '')), ' | ') || ' |')), chr(10)) END"""
_EVERY = "e AS (SELECT *, list_max(list_transform(every, lambda r: len(r))) AS wide FROM (SELECT *, CASE WHEN len(table_data.headers) > 0 THEN list_concat([table_data.headers], coalesce(table_data.rows, [])) ELSE coalesce(table_data.rows, []) END AS every FROM b WHERE table_data IS NOT NULL))"
_PICTURE = sql_norm("coalesce(nullif(b.image.ocr_text, ''), nullif(b.image.caption, ''))")
_MAIN = f"m AS (SELECT b.*, CASE WHEN b.block_type = 'table' AND b.table_data IS NOT NULL THEN e2.md WHEN b.block_type = 'image' AND b.image IS NOT NULL THEN {_PICTURE} ELSE {sql_norm('b.text')} END AS main FROM b LEFT JOIN (SELECT block_id, {_MD_TABLE} AS md FROM e) e2 USING (block_id))"

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {sql_norm('text')} AS text FROM documents",
    "compact_text": rf"SELECT doc_id, regexp_replace({sql_norm('text')}, '[{_WS}]+', ' ', 'g') AS text FROM documents",
    "document_ids": r"""SELECT source_id, 'doc_' || file_type || '_' || substr(json_extract_string(metadata, '$.sha256'), 1, 12) AS document_id,
        CASE WHEN coalesce(s, '') = '' THEN 'file' ELSE s END AS stem FROM (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_filename, '\.[^.]*$', ''), '[^A-Za-z0-9_一-鿿-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS s FROM source_files)""",
    "file_types": r"""SELECT source_id, CASE lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.xlsx' THEN 'xlsx' WHEN '.xlsm' THEN 'xlsx'
        WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.pptx' THEN 'pptx' END AS detected, file_type AS declared FROM source_files""",
    "url_redaction": "SELECT source_id, 'see ' || source_url || ' and ' || source_url || '#part' AS text FROM source_files WHERE source_url <> ''",
    "table_from_rows": f"""WITH {B}, {_TABLE}, n AS (SELECT block_id, list_filter(list_transform(list_concat([heads], rws), lambda r: list_transform(r, lambda c: {sql_norm('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS kept FROM t),
        w AS (SELECT block_id, kept, coalesce(list_max(list_transform(kept, lambda r: len(r))), 0) AS wide FROM n),
        f AS (SELECT block_id, list_transform(kept, lambda r: list_transform(range(wide), lambda i: coalesce(r[i + 1], ''))) AS x FROM w)
        SELECT block_id, coalesce(array_to_string(x[1], '|'), '') AS headers, greatest(len(x) - 1, 0)::BIGINT AS n_rows, array_to_string(list_transform(x[2:], lambda r: array_to_string(r, '|')), '/') AS rows FROM f""",
    "table_markdown": f"WITH {B}, {_EVERY} SELECT block_id, {_MD_TABLE} AS markdown FROM e",
    "labeled_rows": f"""WITH {B}, {_TABLE}, r AS (SELECT block_id, heads, unnest(rws) AS cells, unnest(range(len(rws))) AS "row" FROM t),
        p AS (SELECT block_id, "row", list_filter(list_transform(range(greatest(len(heads), len(cells))), lambda i: {{'h': CASE WHEN i >= len(heads) THEN '列' || (i + 1) ELSE {sql_norm('heads[i + 1]')} END, 'c': {sql_norm('cells[i + 1]')}}}), lambda s: s.h <> '' OR s.c <> '') AS ps FROM r)
        SELECT block_id, "row"::BIGINT AS "row", array_to_string(list_transform(ps, lambda s: CASE WHEN s.h = '' THEN s.c ELSE s.h || ': ' || s.c END), '；') AS text FROM p""",
    "main_text": f"WITH {B}, {_EVERY}, {_MAIN} SELECT block_id, main AS text FROM m",
    "block_preview": f"""WITH {B} SELECT block_id, substr(CASE WHEN coalesce(text, '') <> '' THEN {sql_collapse('text')} WHEN table_data IS NOT NULL THEN array_to_string(list_transform(table_data.headers, lambda h: coalesce(h, '')), ' | ')
        WHEN image IS NOT NULL THEN coalesce(nullif(image.caption, ''), nullif(image.ocr_text, ''), '[image]') ELSE '' END, 1, 240) AS preview FROM b""",
    "context_prefix": f"""WITH {B}, {D} SELECT block_id, concat_ws('。', '文档：' || nullif(title, ''), '城市：' || nullif(d.site, ''), '年份：' || year(parsed_at)::VARCHAR,
        CASE WHEN len(heading_path) > 0 THEN '章节：' || array_to_string(list_transform(heading_path, lambda x: coalesce(x, '')), ' > ') END) AS prefix FROM b JOIN d USING (document_id)""",
    "line_classify": rf"""WITH {B}, l AS (SELECT block_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM b WHERE text IS NOT NULL),
        c AS (SELECT *, CASE WHEN t = '目录' THEN 'skip' WHEN regexp_matches(t, '^表\s*\d+\s*[-－]\s*\d+') THEN 'table_caption' WHEN regexp_matches(t, '^图\s*\d+\s*[-－]\s*\d+') THEN 'figure_caption' WHEN regexp_matches(t, '^单位[:：]') THEN 'table_note'
            WHEN regexp_matches(t, '^[（(]?[一二三四五六七八九十]+[）)、.．]') THEN 'h2' WHEN regexp_matches(t, '^第[一二三四五六七八九十0-9]+[章节]') THEN 'h1'
            WHEN length(t) <= 30 AND NOT regexp_matches(t, '[，。；：,.;:《》]') AND regexp_matches(t, '附表|政策|办法|指南|公报|报告|概况') THEN 'h1' ELSE 'paragraph' END AS k FROM l)
        SELECT block_id, line::BIGINT AS line, CASE WHEN k IN ('h1', 'h2') THEN 'heading' ELSE k END AS kind, CASE k WHEN 'h1' THEN 1 WHEN 'h2' THEN 2 END::BIGINT AS level FROM c""",
    "cover_title": rf"""WITH {B}, {D}, f AS (SELECT document_id, arg_min(text, block_order) AS heading FROM b WHERE block_type = 'heading' AND page_start = 1 AND text IS NOT NULL GROUP BY 1),
        n AS (SELECT document_id, title, heading, lower({sql_norm('title')}) AS low FROM d LEFT JOIN f USING (document_id))
        SELECT document_id, CASE WHEN (starts_with(low, 'microsoft word') OR regexp_matches(low, '\.(doc|docx|pdf)$') OR low IN ('untitled', 'document', '')) AND heading IS NOT NULL THEN heading ELSE title END AS title FROM n""",
    "asset_states": rf"""WITH {B}, {D}, i AS (SELECT block_id, file_type, coalesce(image.image_path, '') AS p, source_trace.raw_locator AS loc FROM b JOIN d USING (document_id) WHERE block_type = 'image'),
        r AS (SELECT block_id, CASE WHEN file_type IN ('html', 'markdown') THEN CASE WHEN p = '' THEN 'IMAGE_REFERENCE_MISSING' WHEN regexp_matches(lower(p), '^https?://') THEN 'REMOTE_IMAGE_REQUIRES_FETCH_POLICY' WHEN starts_with(lower(p), 'data:') THEN 'inline'
            WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]+:') THEN 'UNSUPPORTED_IMAGE_URI' WHEN regexp_matches(p, '(^|/)\.\.(/|$)') OR starts_with(p, '/') THEN 'IMAGE_PATH_OUTSIDE_SOURCE_ROOT' ELSE 'local' END
            WHEN file_type = 'docx' THEN CASE WHEN p = '' THEN 'DOCX_IMAGE_PART_MISSING' ELSE 'member' END WHEN file_type = 'pptx' THEN CASE WHEN loc IS NULL THEN 'PPTX_PICTURE_LOCATOR_MISSING' ELSE 'member' END
            WHEN file_type = 'xlsx' THEN CASE WHEN p = '' THEN 'XLSX_IMAGE_LOCATOR_MISSING' ELSE 'member' END ELSE 'UNSUPPORTED_IMAGE_SOURCE' END AS k FROM i)
        SELECT block_id, CASE WHEN k IN ('inline', 'local', 'member') THEN k ELSE 'missing' END AS status, CASE WHEN k NOT IN ('inline', 'local', 'member') THEN k END AS reason_code FROM r""",
    "markdown_export": rf"""WITH {B}, {D}, {_EVERY}, {_MAIN}, k AS (SELECT document_id, block_order, coalesce(page_start, 0) AS p, block_id, CASE WHEN block_type = 'heading' THEN repeat('#', greatest(least(CASE WHEN coalesce(heading_level, 0) = 0 THEN 2 ELSE heading_level END, 6), 2)::BIGINT) || ' ' || main
            WHEN block_type = 'list_item' THEN '- ' || main WHEN block_type = 'image' THEN '[图片：' || main || ']' ELSE main END AS md FROM m WHERE NOT coalesce(excluded_from_retrieval, false) AND main <> ''),
        g AS (SELECT document_id, string_agg(md, chr(10) || chr(10) ORDER BY block_order, p, block_id) AS body FROM k GROUP BY 1)
        SELECT document_id, regexp_replace(concat_ws(chr(10) || chr(10), '# ' || nullif(title, ''), body), '[{_WS}]+$', '') || chr(10) AS markdown FROM d LEFT JOIN g USING (document_id)""",
}
