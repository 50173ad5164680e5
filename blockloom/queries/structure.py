"""Queries of cleaning, repair, quality and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import clean, quality, repair, validate
from blockloom.plans import pipeline
from blockloom.queries.text import B, D, blocks, documents, sql_collapse, sql_norm
from blockloom.tables import table


def noise_filter(spark, sf):
    return clean.without_noise(clean.normalized(blocks(spark, sf))).select("block_id", "text")


def short_dedup(spark, sf):
    return clean.without_repeats(clean.without_noise(clean.normalized(blocks(spark, sf)))).select("block_id")


def contents_pages(spark, sf):
    # Headings as a table of contents would print them.
    entry = F.concat("text", F.lit(" ..... "), F.col("block_order").cast("string"))
    rows = blocks(spark, sf).withColumn("text", F.when(F.col("block_type") == "heading", entry).otherwise(F.col("text")))
    return clean.mark_contents(rows).where("is_contents").select("block_id")


def clean_blocks(spark, sf):
    out = clean.clean(blocks(spark, sf))
    return out.select("block_id", "text", "excluded_from_retrieval", F.array_join("quality_flags", ",").alias("flags"))


def reading_order(spark, sf):
    return repair.reading_order(blocks(spark, sf)).select("block_id", F.col("pos").cast("bigint").alias("pos"))


def cross_page_merge(spark, sf):
    out = repair.merge_paragraphs(repair.reading_order(blocks(spark, sf)))
    return out.select("block_id", "text", F.col("page_end").cast("bigint").alias("page_end"), F.array_join("merged_block_ids", ",").alias("merged"), F.size("quality_flags").cast("bigint").alias("n_flags"))


def _pages_of_tables(spark, sf):
    """The tables of each document as if they stood on successive pages, which gives continued ones."""
    from pyspark.sql import Window

    rows = blocks(spark, sf).where("block_type = 'table'")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "block_id"))
    # Every second table takes the headers of the one before it.
    rows = rows.withColumn("n", n).withColumn("page_start", F.col("n")).withColumn("page_end", F.col("n"))
    before = F.lag("table_data.headers").over(Window.partitionBy("document_id").orderBy("n"))
    return rows.withColumn("table_data", F.col("table_data").withField("headers", F.when((F.col("n") % 2 == 0) & before.isNotNull(), before).otherwise(F.col("table_data.headers")))).withColumn("pos", F.col("n"))


def continued_tables(spark, sf):
    out = repair.merge_tables(_pages_of_tables(spark, sf))
    return out.select("block_id", F.size("table_data.rows").cast("bigint").alias("n_rows"), F.col("page_end").cast("bigint").alias("page_end"), "is_continued_table")


def heading_path(spark, sf):
    out = repair.heading_paths(blocks(spark, sf).withColumn("heading_path", F.array().cast("array<string>")))
    return out.select("block_id", F.array_join("heading_path", " > ").alias("path"))


def processed_blocks(spark, sf):
    out = pipeline.process(blocks(spark, sf))
    return out.select("block_id", F.col("pos").cast("bigint").alias("pos"), "text", F.array_join("heading_path", " > ").alias("path"))


def blocks_by_type(spark, sf):
    return quality.counts_by_type(blocks(spark, sf))


def flag_counts(spark, sf):
    return quality.flag_counts(blocks(spark, sf))


def flag_warnings(spark, sf):
    return quality.flag_warnings(blocks(spark, sf)).select("document_id", "warning_type", F.col("page_number").cast("bigint").alias("page_number"), "block_id", "message")


def quality_summary(spark, sf):
    out = quality.summaries(blocks(spark, sf))
    return out.select("document_id", *(F.col(c).cast("bigint").alias(c) for c in ("page_count", "block_count", "table_count", "image_count", "ocr_candidate_count", "excluded_count", "warning_count")))


def block_reviews(spark, sf):
    return quality.block_reviews(blocks(spark, sf)).select("review_id", "review_type", "object_id", "reason", "source_preview")


def evaluation_status(spark, sf):
    out = quality.evaluations(blocks(spark, sf))
    return out.select("document_id", "status", F.col("block_count").cast("bigint").alias("block_count"), F.col("warning_count").cast("bigint").alias("warning_count"), F.col("review_count").cast("bigint").alias("review_count"))


def batch_report(spark, sf):
    return quality.batch_report(quality.evaluations(blocks(spark, sf)))


def document_violations(spark, sf):
    return validate.document_violations(documents(spark, sf))


def block_violations(spark, sf):
    return validate.block_violations(blocks(spark, sf), documents(spark, sf)).select("block_id", "violation")


def duplicate_ids(spark, sf):
    return validate.duplicate_ids(table(spark, sf, "blocks"))


def review_gate(spark, sf):
    e = quality.evaluations(blocks(spark, sf)).select("document_id", F.lit("base_run").alias("source"), "status", "error_count", F.array_repeat(F.lit("pending"), F.col("review_count").cast("int")).alias("item_statuses"))
    return validate.review_gate(e).select("document_id", "passes")


QUERIES = {
    f.__name__: f
    for f in (
        noise_filter, short_dedup, contents_pages, clean_blocks, reading_order, cross_page_merge, continued_tables, heading_path, processed_blocks, blocks_by_type, flag_counts,
        flag_warnings, quality_summary, block_reviews, evaluation_status, batch_report, document_violations, block_violations, duplicate_ids, review_gate,
    )
}

_TEXTS = "('paragraph', 'heading', 'list_item')"
_N = f"n AS (SELECT * REPLACE (CASE WHEN text IS NOT NULL THEN {sql_norm('text')} END AS text) FROM b)"
_KEPT = f"k AS (SELECT * FROM n WHERE NOT (block_type IN {_TEXTS} AND (coalesce(text, '') = '' OR text IN ('首页', '政务公开', '互动交流', '网站地图', '友情链接', '版权声明'))))"
_UNIQUE = f"""u AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_type IN {_TEXTS}, text ORDER BY block_order) AS r FROM k)
    WHERE NOT (block_type IN {_TEXTS} AND length(text) <= 40) OR r = 1)"""
_PAGE_TEXT = f"block_type IN {_TEXTS} AND coalesce(text, '') <> ''"


def _contents(source: str) -> str:
    n = f"count(*) FILTER ({_PAGE_TEXT}) OVER w"
    k = rf"count(*) FILTER ({_PAGE_TEXT} AND regexp_matches(text, '\.{{4,}}\s*\d+\s*$')) OVER w"
    return f"SELECT *, page_start IS NOT NULL AND {k} >= 3 AND {k} / greatest({n}, 1) >= 0.5 AS is_contents FROM {source} WINDOW w AS (PARTITION BY document_id, page_start)"


_FLAGS = "f AS (SELECT document_id, block_id, block_order, page_start, unnest(quality_flags) AS flag, unnest(range(len(quality_flags))) AS i FROM b)"
_PAGE_FLAGS = "('table_of_contents', 'manual_review', 'auto_ocr_candidate', 'review_before_ocr', 'auto_ocr')"
_WARN = f"""w AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, warning_type, page_number, block_id ORDER BY block_order, i) AS rn FROM (
    SELECT document_id, flag AS warning_type, page_start AS page_number, CASE WHEN flag NOT IN {_PAGE_FLAGS} THEN block_id END AS block_id, block_order, i,
    CASE WHEN flag IN {_PAGE_FLAGS} THEN 'Page ' || coalesce(page_start::VARCHAR, 'None') || ' contains blocks with quality flag: ' || flag ELSE 'Block ' || block_id || ' has quality flag: ' || flag END AS message FROM f)) WHERE rn = 1)"""
_KINDS = "('merged_cross_page_paragraph', 'merged_continued_table', 'manual_review')"
_EVAL = f"""e AS (SELECT document_id, block_count, coalesce(warning_count, 0) AS warning_count, coalesce(review_count, 0) AS review_count FROM (SELECT document_id, count(*) AS block_count FROM b GROUP BY 1)
    LEFT JOIN (SELECT document_id, count(*) AS warning_count FROM w GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS review_count FROM f WHERE flag IN {_KINDS} GROUP BY 1) USING (document_id)),
    s AS (SELECT *, CASE WHEN review_count > 0 OR warning_count > 0 THEN 'review_required' ELSE 'finalized' END AS status FROM e)"""


def _order(source: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page_start::DOUBLE, 1e9), coalesce(CASE WHEN len(bbox) = 4 THEN bbox[2] END, block_order::DOUBLE), coalesce(CASE WHEN len(bbox) = 4 THEN bbox[1] END, 0), block_order) AS pos FROM {source}"""


_SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _merge(source: str) -> str:
    """CTEs that merge paragraphs over page ends; the last is mp."""
    return rf"""c1 AS (SELECT *, block_type = 'paragraph' AND coalesce(text, '') <> '' AND coalesce(len(bbox) = 4, false) AS has FROM {source}),
    c2 AS (SELECT *, coalesce(has AND lag(has) OVER v AND page_start = lag(page_end) OVER v + 1 AND page_height > 0 AND bbox[2] <= page_height * 0.25 AND NOT regexp_matches(lag(text) OVER v, '[。！？.!?；;：:]$') AND length(text) > 10, false) AS c,
        coalesce(lag(page_height) OVER v > 0 AND lag(CASE WHEN len(bbox) = 4 THEN bbox[4] END) OVER v >= lag(page_height) OVER v * 0.70, false) AS low FROM c1 WINDOW v AS (PARTITION BY document_id ORDER BY pos)),
    c3 AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY pos) AS isl FROM c2),
    c4 AS (SELECT *, c AND coalesce(max(CASE WHEN c THEN low END) OVER (PARTITION BY document_id, isl ORDER BY pos), false) AS link FROM c3),
    c5 AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY pos) AS grp FROM c4),
    c6 AS (SELECT document_id, grp, count(*) AS parts, string_agg(regexp_replace(CASE WHEN link THEN regexp_replace(text, '^{_SPACE}+', '') ELSE text END, '{_SPACE}+$', ''), '' ORDER BY pos) AS glued, arg_max(page_end, pos) AS last_page,
        coalesce(string_agg(CASE WHEN link THEN block_id END, ',' ORDER BY pos), '') AS merged FROM c5 GROUP BY 1, 2),
    mp AS (SELECT c5.* EXCLUDE (text, page_end), CASE WHEN parts > 1 THEN glued ELSE text END AS text, CASE WHEN parts > 1 THEN last_page ELSE page_end END AS page_end, merged, parts FROM c5 JOIN c6 USING (document_id, grp) WHERE NOT link)"""


def _paths(source: str, deepest: int = 16) -> str:
    """CTEs that give each row its heading path; the last is hp."""
    steps = ", ".join(f"last_value(CASE WHEN push AND depth = {d} THEN text END IGNORE NULLS) OVER z AS s{d}" for d in range(1, deepest + 1))
    return f"""h1 AS (SELECT *, coalesce(block_type = 'heading' AND coalesce(text, '') <> '' AND NOT coalesce(excluded_from_retrieval, false), false) AS push FROM {source}),
    h2 AS (SELECT *, sum(CASE WHEN push THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS k FROM h1),
    h3 AS (SELECT *, CASE WHEN push THEN k + least(0, min(CASE WHEN push THEN greatest(coalesce(heading_level, 1) - 1, 0) + 1 - k END) OVER (PARTITION BY document_id ORDER BY pos)) END AS depth FROM h2),
    h4 AS (SELECT *, coalesce(last_value(depth IGNORE NULLS) OVER z, 0) AS open, {steps} FROM h3 WINDOW z AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    hp AS (SELECT * EXCLUDE (heading_path), CASE WHEN NOT push AND NOT coalesce(excluded_from_retrieval, false) AND len(heading_path) > 0 THEN array_to_string(heading_path, ' > ')
        ELSE coalesce(array_to_string(([{", ".join(f"s{d}" for d in range(1, deepest + 1))}])[1:open::BIGINT], ' > '), '') END AS path FROM h4)"""


ORACLE_SQL = {
    "noise_filter": f"WITH {B}, {_N}, {_KEPT} SELECT block_id, text FROM k",
    "short_dedup": f"WITH {B}, {_N}, {_KEPT}, {_UNIQUE} SELECT block_id FROM u",
    "contents_pages": f"WITH {B}, p AS (SELECT * REPLACE (CASE WHEN block_type = 'heading' THEN text || ' ..... ' || block_order ELSE text END AS text) FROM b), c AS ({_contents('p')}) SELECT block_id FROM c WHERE is_contents",
    "clean_blocks": f"""WITH {B}, {_N}, {_KEPT}, {_UNIQUE}, c AS ({_contents('u')}) SELECT block_id, text, is_contents OR coalesce(excluded_from_retrieval, false) AS excluded_from_retrieval,
        array_to_string(CASE WHEN is_contents AND NOT coalesce(list_contains(quality_flags, 'table_of_contents'), false) THEN list_append(coalesce(quality_flags, []), 'table_of_contents') ELSE coalesce(quality_flags, []) END, ',') AS flags FROM c""",
    "reading_order": f"WITH {B}, o AS ({_order('b')}) SELECT block_id, pos::BIGINT AS pos FROM o",
    "cross_page_merge": f"WITH {B}, o AS ({_order('b')}), {_merge('o')} SELECT block_id, text, page_end::BIGINT AS page_end, merged, (len(coalesce(quality_flags, [])) + parts - 1)::BIGINT AS n_flags FROM mp",
    "continued_tables": f"""WITH {B}, t0 AS (SELECT document_id, block_id, table_data.headers AS h, table_data.rows AS r, row_number() OVER (PARTITION BY document_id ORDER BY block_order, block_id) AS n FROM b WHERE block_type = 'table'),
        t1 AS (SELECT * REPLACE (CASE WHEN n % 2 = 0 AND lag(h) OVER v IS NOT NULL THEN lag(h) OVER v ELSE h END AS h) FROM t0 WINDOW v AS (PARTITION BY document_id ORDER BY n)),
        t2 AS (SELECT *, coalesce(len(h) > 0 AND h = lag(h) OVER v, false) AS link FROM t1 WINDOW v AS (PARTITION BY document_id ORDER BY n)),
        t3 AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY n) AS g FROM t2)
        SELECT arg_min(block_id, n) AS block_id, sum(len(coalesce(r, [])))::BIGINT AS n_rows, max(n)::BIGINT AS page_end, count(*) > 1 AS is_continued_table FROM t3 GROUP BY document_id, g""",
    "heading_path": f"WITH {B}, o AS (SELECT * EXCLUDE (heading_path), []::VARCHAR[] AS heading_path, block_order AS pos FROM b), {_paths('o')} SELECT block_id, path FROM hp",
    "processed_blocks": f"""WITH {B}, {_N}, {_KEPT}, {_UNIQUE}, cc AS ({_contents('u')}), ce AS (SELECT * REPLACE (is_contents OR coalesce(excluded_from_retrieval, false) AS excluded_from_retrieval) FROM cc), o AS ({_order('ce')}), {_merge('o')},
        lt AS (SELECT *, coalesce(block_type = 'table' AND lag(block_type) OVER v = 'table' AND page_start = lag(page_end) OVER v + 1 AND len(table_data.headers) > 0 AND table_data.headers = lag(table_data.headers) OVER v, false) AS tlink FROM mp WINDOW v AS (PARTITION BY document_id ORDER BY pos)),
        ot AS (SELECT * FROM lt WHERE NOT tlink), {_paths('ot')} SELECT block_id, row_number() OVER (PARTITION BY document_id ORDER BY pos)::BIGINT AS pos, text, path FROM hp""",
    "blocks_by_type": f"WITH {B} SELECT document_id, block_type, count(*) AS n FROM b GROUP BY 1, 2",
    "flag_counts": f"WITH {B}, {_FLAGS} SELECT document_id, flag, count(*) AS n FROM f GROUP BY 1, 2",
    "flag_warnings": f"WITH {B}, {_FLAGS}, {_WARN} SELECT document_id, warning_type, page_number::BIGINT AS page_number, block_id, message FROM w",
    "quality_summary": f"""WITH {B}, {_FLAGS}, {_WARN} SELECT document_id, max(page_start)::BIGINT AS page_count, count(*) AS block_count, count(*) FILTER (block_type = 'table') AS table_count, count(*) FILTER (block_type = 'image') AS image_count,
        count(*) FILTER (ocr_decision IN ('auto_ocr_candidate', 'manual_review', 'auto_ocr', 'review_before_ocr')) AS ocr_candidate_count, count(*) FILTER (excluded_from_retrieval) AS excluded_count, coalesce(any_value(wc), 0)::BIGINT AS warning_count
        FROM b LEFT JOIN (SELECT document_id, count(*) AS wc FROM w GROUP BY 1) USING (document_id) GROUP BY document_id""",
    "block_reviews": f"""WITH {B}, {_FLAGS} SELECT 'review_' || substr(sha1(f.document_id || '|' || f.block_id || '|' || flag), 1, 12) AS review_id,
        CASE flag WHEN 'merged_cross_page_paragraph' THEN 'cross_page_paragraph' WHEN 'merged_continued_table' THEN 'continued_table' ELSE 'parser_quality' END AS review_type, f.block_id AS object_id,
        CASE flag WHEN 'merged_cross_page_paragraph' THEN 'A paragraph was merged across consecutive pages.' WHEN 'merged_continued_table' THEN 'Tables on consecutive pages were merged.' ELSE 'The parser marked this block for manual review.' END AS reason,
        substr(CASE WHEN coalesce(text, '') <> '' THEN {sql_collapse('text')} WHEN table_data IS NOT NULL THEN array_to_string(list_transform(table_data.headers, lambda h: coalesce(h, '')), ' | ') WHEN image IS NOT NULL THEN coalesce(nullif(image.caption, ''), nullif(image.ocr_text, ''), '[image]') ELSE '' END, 1, 240) AS source_preview
        FROM f JOIN b USING (block_id) WHERE flag IN {_KINDS}""",
    "evaluation_status": f"WITH {B}, {_FLAGS}, {_WARN}, {_EVAL} SELECT document_id, status, block_count, warning_count::BIGINT AS warning_count, review_count::BIGINT AS review_count FROM s",
    "batch_report": f"WITH {B}, {_FLAGS}, {_WARN}, {_EVAL} SELECT count(*) AS total, count(*) FILTER (status = 'finalized') AS finalized, count(*) FILTER (status = 'review_required') AS review_required, 0::BIGINT AS failed, 0::BIGINT AS cancelled FROM s",
    "document_violations": f"""WITH {D}, v AS (SELECT document_id, unnest([CASE WHEN trim(coalesce(title, '')) = '' THEN 'title is required' END, CASE WHEN trim(coalesce(file_type, '')) = '' THEN 'file_type is required' END, CASE WHEN trim(coalesce(source_path, '')) = '' THEN 'source_path is required' END,
        CASE WHEN parsed_at IS NULL THEN 'parsed_at is required' END, CASE WHEN json_extract_string(metadata, '$.schema_version') IS DISTINCT FROM '1.0' THEN 'schema_version differs' END]) AS violation FROM d) SELECT document_id, violation FROM v WHERE violation IS NOT NULL""",
    "block_violations": f"""WITH {B}, {D}, v AS (SELECT block_id, unnest([CASE WHEN len(bbox) <> 4 THEN 'bbox needs four numbers' END, CASE WHEN page_start < 1 THEN 'page_start is below 1' END, CASE WHEN page_end < page_start THEN 'page_end is before page_start' END, CASE WHEN block_order IS NULL OR block_order < 0 THEN 'order is below 0' END,
        CASE WHEN block_type = 'table' AND len(list_filter(flatten(coalesce(table_data.rows, [])), lambda c: c IS NULL)) > 0 THEN 'a cell is null' END, CASE WHEN image IS NOT NULL AND trim(coalesce(image.image_id, '')) = '' THEN 'image_id is required' END,
        CASE WHEN source_trace IS NOT NULL AND trim(coalesce(source_trace.parser, '')) = '' THEN 'parser is required' END, CASE WHEN source_trace.raw_object_index < 0 THEN 'raw_object_index is below 0' END, CASE WHEN d.document_id IS NULL THEN 'document is unknown' END]) AS violation
        FROM b LEFT JOIN d USING (document_id)) SELECT block_id, violation FROM v WHERE violation IS NOT NULL""",
    "duplicate_ids": "SELECT document_id, block_id, count(*) AS n FROM blocks GROUP BY 1, 2 HAVING count(*) > 1",
    "review_gate": f"WITH {B}, {_FLAGS}, {_WARN}, {_EVAL} SELECT document_id, NOT (review_count > 0 OR status = 'review_required') AS passes FROM s",
}
