"""Contracts of documents and blocks, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _violations(rows: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def document_violations(documents: DataFrame, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """(document_id, violation)."""
    version = F.get_json_object("metadata", "$.schema_version")
    return _violations(documents, ["document_id"], [
        F.when(_blank("document_id"), "document_id is required"), F.when(_blank("title"), "title is required"), F.when(_blank("file_type"), "file_type is required"), F.when(_blank("source_path"), "source_path is required"),
        F.when(F.col("parsed_at").isNull(), "parsed_at is required"), F.when(~version.eqNullSafe(F.lit(schema_version)), "schema_version differs"),
    ])


def block_violations(blocks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, block_id, violation)."""
    bad_box = F.col("bbox").isNotNull() & (F.size("bbox") != 4)
    rows = blocks
    checks = [
        F.when(_blank("block_id"), "block_id is required"), F.when(_blank("block_type"), "block_type is required"), F.when(bad_box, "bbox needs four numbers"),
        F.when(F.col("page_start") < 1, "page_start is below 1"), F.when(F.col("page_end") < F.col("page_start"), "page_end is before page_start"), F.when(F.col("block_order").isNull() | (F.col("block_order") < 0), "order is below 0"),
        F.when((F.col("block_type") == "table") & F.exists(F.coalesce("table_data.rows", F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: c.isNull())), "a cell is null"),
        F.when(F.col("image").isNotNull() & (F.trim(F.coalesce(F.col("image.image_id"), F.lit(""))) == ""), "image_id is required"),
        F.when(F.col("source_trace").isNotNull() & (F.trim(F.coalesce(F.col("source_trace.parser"), F.lit(""))) == ""), "parser is required"),
        F.when(F.col("source_trace.raw_object_index") < 0, "raw_object_index is below 0"),
    ]
    if documents is not None:
        rows = rows.join(documents.select("document_id").distinct().withColumn("__known", F.lit(True)), "document_id", "left")
        checks.append(F.when(F.col("__known").isNull(), "document is unknown"))
    return _violations(rows, ["document_id", "block_id"], checks)


def duplicate_ids(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, n) of ids used more than once."""
    return blocks.groupBy("document_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")


def review_gate(documents: DataFrame) -> DataFrame:
    """Adds passes: whether a revision may be loaded as complete.

    documents: source, status, error_count, item_statuses.  Failed and blocked ones, errors, open items, and a base run
    that asks for review don't pass; a later revision that only has warnings does."""
    open_ = F.exists(F.coalesce("item_statuses", F.array().cast("array<string>")), lambda s: ~F.coalesce(s, F.lit("")).isin("resolved", "applied", "excluded"))
    bad = F.coalesce(F.col("status").isin("failed", "blocked"), F.lit(True)) | (F.coalesce("error_count", F.lit(-1)) != 0) | open_ | ((F.col("source") == "base_run") & (F.col("status") == "review_required"))
    return documents.withColumn("passes", ~bad)


def task_violations(tasks: DataFrame) -> DataFrame:
    """(review_id, violation) of review tasks."""
    none = F.coalesce(F.size("target_block_ids"), F.lit(0)) <= 0
    return _violations(tasks, ["review_id"], [
        F.when(_blank("review_id"), "review_id is required"), F.when(_blank("document_id"), "document_id is required"), F.when(F.col("page_number") < 1, "page_number is below 1"), F.when(F.col("page_number").isNull() & none, "a page or blocks are required"),
        F.when(~F.coalesce(F.array_contains("allowed_actions", F.col("suggested_action")), F.lit(False)), "suggested_action is not allowed"),
    ])


def report_violations(reports: DataFrame) -> DataFrame:
    """(document_id, violation) of quality reports (document_id, report_document_id, warnings of level, warning_type, message,
    page_number, block_id)."""
    lacks = lambda f: F.exists("warnings", lambda w: F.regexp_replace(F.coalesce(w[f], F.lit("")), r"(?U)\s+", "") == "")
    return _violations(reports, ["document_id"], [
        F.when(~F.col("report_document_id").eqNullSafe(F.col("document_id")), "report names another document"), F.when(F.col("warnings").isNull(), "warnings are required"),
        *(F.when(lacks(f), f"{f} is required") for f in ("level", "warning_type", "message")), F.when(F.exists("warnings", lambda w: w["page_number"] < 1), "page_number is below 1"),
    ])
