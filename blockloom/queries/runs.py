"""Queries of runs, jobs, previews and written records."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import ocr, runs
from blockloom.queries.pages import _FEAT, _features
from blockloom.queries.text import B, D, blocks, documents
from blockloom.sources import records
from blockloom.tables import table


def job_progress(spark, sf):
    n = F.col("source_id") % 5
    status = F.when(n == 0, "failed").when(n == 1, "review_required").when(n == 2, "running").otherwise("finalized")
    f = table(spark, sf, "source_files").select(F.coalesce("site", F.lit("none")).alias("job_id"), status.alias("status"))
    return runs.progress(f)


def file_overlay(spark, sf):
    d = documents(spark, sf)
    files = d.select("document_id", F.lit("review_required").alias("status"), "block_count")
    revisions = d.where("right(document_id, 1) in ('0', '1', '2', '3')").select("document_id", F.when(F.expr("right(document_id, 1) = '0'"), "base_run").otherwise("ocr_review").alias("source"), F.lit("finalized").alias("status"), (F.col("block_count") + 1).alias("block_count"))
    return runs.overlay(files, revisions).select("document_id", "status", F.col("block_count").cast("bigint").alias("block_count"))


def run_manifests(spark, sf):
    log = table(spark, sf, "ocr_decisions").dropDuplicates(["seq"]).select(F.col("document_id").alias("run_id"), F.col("selected_action").alias("stage"), "seq")
    failed = log.where("stage = 'reject_document'")
    return runs.manifests(log, failed)


def execution_states(spark, sf):
    log = table(spark, sf, "ocr_decisions").dropDuplicates(["seq"])
    return runs.execution_state(log.select(F.col("document_id").alias("run_id"), F.when(F.col("seq") % 4 == 0, "TimeoutError").alias("error_type")))


def picture_decisions(spark, sf):
    pages = _features(spark, sf).withColumn("d", ocr.page_decision()).select("document_id", "page", "d.decision", "d.reason_code")
    pictures = blocks(spark, sf).where("page_start is not null and block_type = 'heading'").select("document_id", F.col("page_start").alias("page"), "block_id", (F.col("block_order") / 7.0).cast("double").alias("area_ratio"))
    out = runs.picture_decisions(pictures, pages)
    return out.select("block_id", "ocr_decision", F.array_join("quality_flags", ",").alias("flags"), "area_ratio")


def page_warnings(spark, sf):
    pages = _features(spark, sf).withColumn("d", ocr.page_decision()).select("document_id", "page", "d.decision", "d.reason_code")
    return runs.page_warnings(pages).select("document_id", "warning_type", F.col("page_number").cast("bigint").alias("page_number"), "message")


def table_previews(spark, sf):
    return blocks(spark, sf).where("table_data is not null").select("block_id", runs.table_preview("table_data", 2, 2).alias("html"))


def block_previews(spark, sf):
    return runs.first_of_each(blocks(spark, sf), 3).select("block_id")


def json_round_trip(spark, sf):
    """Documents written as JSON texts and read again: their blocks."""
    b = blocks(spark, sf).select("document_id", "block_id", "block_type", "text", "page_start", "quality_flags", "block_order")
    d = documents(spark, sf).select("document_id", "title", "file_type", "source_path", "metadata", F.col("parsed_at").cast("string").alias("parsed_at"))
    from blockloom.operators import export

    read = records.documents_of(export.document_json(b, d))
    out = records.blocks_of(read)
    return out.select(F.col("of_document").alias("document_id"), "block_id", "block_type", "text", F.array_join("quality_flags", ",").alias("flags"))


QUERIES = {f.__name__: f for f in (job_progress, file_overlay, run_manifests, execution_states, picture_decisions, page_warnings, table_previews, block_previews, json_round_trip)}

_L = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY received_at) AS rn FROM ocr_decisions) WHERE rn = 1)"
_P = f"""{_FEAT}, p AS (SELECT document_id, page, CASE WHEN text_length = 0 AND image_count = 0 AND table_count = 0 THEN 'BLANK_PAGE' WHEN cid_count >= 3 OR garbled_ratio >= 0.08 THEN 'NATIVE_TEXT_GARBLED' WHEN text_length <= 30 AND word_count <= 6 AND max_image_area_ratio >= 0.60 THEN 'SCANNED_PAGE'
    WHEN table_count > 0 AND table_empty_ratio >= 0.45 THEN 'NATIVE_TABLE_LOW_QUALITY' WHEN text_length < 100 AND image_count > 0 AND max_image_area_ratio >= 0.20 THEN 'MIXED_PAGE_LOW_TEXT' ELSE 'NATIVE_PARSE_USABLE' END AS code FROM ft),
    q AS (SELECT *, CASE code WHEN 'BLANK_PAGE' THEN 'skip_ocr' WHEN 'NATIVE_TEXT_GARBLED' THEN 'auto_ocr' WHEN 'SCANNED_PAGE' THEN 'auto_ocr' WHEN 'NATIVE_PARSE_USABLE' THEN 'skip_ocr' ELSE 'review_before_ocr' END AS decision FROM p)"""
_ESC = "replace(replace(replace(replace(replace(coalesce(c, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLE_SQL = {
    "job_progress": """WITH f AS (SELECT coalesce(site, 'none') AS job_id, CASE source_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'review_required' WHEN 2 THEN 'running' ELSE 'finalized' END AS status FROM source_files)
        SELECT job_id, count(*) AS total, count(*) FILTER (status <> 'running') AS completed, count(*) FILTER (status = 'finalized') AS finalized, count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS cancelled FROM f GROUP BY 1""",
    "file_overlay": f"WITH {D} SELECT document_id, CASE WHEN right(document_id, 1) IN ('1', '2', '3') THEN 'finalized' ELSE 'review_required' END AS status, (block_count + CASE WHEN right(document_id, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END)::BIGINT AS block_count FROM d",
    "run_manifests": f"WITH {_L} SELECT document_id AS run_id, arg_max(selected_action, seq) AS last_completed_stage, count(*) AS n_stages, CASE WHEN bool_or(selected_action = 'reject_document') THEN 'failed' ELSE 'completed' END AS status FROM l GROUP BY 1",
    "execution_states": f"WITH {_L} SELECT document_id AS run_id, count(*) FILTER (seq % 4 <> 0) AS succeeded, count(*) FILTER (seq % 4 = 0) AS failed, CASE WHEN bool_or(seq % 4 = 0) THEN 'completed_with_errors' ELSE 'completed' END AS status FROM l GROUP BY 1",
    "picture_decisions": f"WITH {B}, {_P} SELECT block_id, decision AS ocr_decision, CASE WHEN decision <> 'skip_ocr' THEN decision ELSE '' END AS flags, round(block_order / 7.0, 6) AS area_ratio FROM b JOIN q ON q.document_id = b.document_id AND q.page = b.page_start WHERE block_type = 'heading'",
    "page_warnings": f"WITH {B}, {_P} SELECT document_id, decision AS warning_type, page::BIGINT AS page_number, code AS message FROM q WHERE decision <> 'skip_ocr'",
    "table_previews": f"""WITH {B}, t AS (SELECT block_id, list_concat([coalesce(table_data.headers, [])], coalesce(table_data.rows, []))[1:2] AS x FROM b WHERE table_data IS NOT NULL)
        SELECT block_id, '<table>' || array_to_string(list_transform(x, lambda r: '<tr>' || array_to_string(list_transform(r[1:2], lambda c: '<td>' || {_ESC} || '</td>'), '') || '</tr>'), '') || '</table>' AS html FROM t""",
    "block_previews": f"WITH {B} SELECT block_id FROM (SELECT block_id, row_number() OVER (PARTITION BY document_id ORDER BY block_order, block_id) AS n FROM b) WHERE n <= 3",
    "json_round_trip": f"WITH {B}, {D} SELECT document_id, block_id, block_type, text, array_to_string(coalesce(quality_flags, []), ',') AS flags FROM b JOIN d USING (document_id)",
}
