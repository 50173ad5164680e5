"""Quality warnings, summaries and evaluation of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.text import preview, short_sha1

#: Flags that give one warning a page; decisions that make a block a candidate for OCR.
PAGE_FLAGS = ("table_of_contents", "manual_review", "auto_ocr_candidate", "review_before_ocr", "auto_ocr")
OCR_CANDIDATES = ("auto_ocr_candidate", "manual_review", "auto_ocr", "review_before_ocr")
#: Flag, type of review, reason.
REVIEWS = (
    ("merged_cross_page_paragraph", "cross_page_paragraph", "A paragraph was merged across consecutive pages."),
    ("merged_continued_table", "continued_table", "Tables on consecutive pages were merged."),
    ("manual_review", "parser_quality", "The parser marked this block for manual review."),
)
#: Fixed value.
ACTION = "Review the source and approve, correct, exclude, or reject."


def _flags(blocks: DataFrame) -> DataFrame:
    return blocks.select("document_id", "block_id", "pos", "page_start", F.posexplode(F.coalesce("quality_flags", F.array().cast("array<string>"))).alias("k", "flag"))


def counts_by_type(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id", "block_type").agg(F.count("*").alias("n"))


def flag_counts(blocks: DataFrame) -> DataFrame:
    """How often each flag stands in each document, repeats included."""
    return _flags(blocks).groupBy("document_id", "flag").agg(F.count("*").alias("n"))


def flag_warnings(blocks: DataFrame) -> DataFrame:
    """(document_id, warning_type, message, page_number, block_id, phase, pos, k): page flags once a page, others once a block and flag."""
    rows = _flags(blocks)
    page = F.col("flag").isin(*PAGE_FLAGS)
    # The texts of the messages are fixed values.
    rows = rows.select(
        "document_id", F.lit("warning").alias("level"), F.col("flag").alias("warning_type"), F.col("page_start").alias("page_number"),
        F.when(~page, F.col("block_id")).alias("block_id"),
        F.when(page, F.concat(F.lit("Page "), F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.lit(" contains blocks with quality flag: "), "flag")).otherwise(F.concat(F.lit("Block "), "block_id", F.lit(" has quality flag: "), "flag")).alias("message"),
        F.lit(1).alias("phase"), "pos", "k",
    )
    return first_warnings(rows)


def first_warnings(warnings: DataFrame) -> DataFrame:
    """Of warnings of equal document, type, page and block the first."""
    key = Window.partitionBy("document_id", "warning_type", "page_number", "block_id").orderBy("phase", "pos", "k")
    return warnings.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n")


def _every(documents: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows, and one for each document that has none."""
    return rows if documents is None else documents.select("document_id").distinct().join(rows, "document_id", "left")


def summaries(blocks: DataFrame, warnings: DataFrame | None = None, raw_counts: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """One row a document, also for those without blocks if the documents are given: counts, highest page, candidates for
    OCR, excluded blocks, warnings."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = blocks.groupBy("document_id").agg(
        F.max("page_start").alias("page_count"), F.count("*").alias("block_count"), count(F.col("block_type") == "table").alias("table_count"), count(F.col("block_type") == "image").alias("image_count"),
        count(F.col("ocr_decision").isin(*OCR_CANDIDATES)).alias("ocr_candidate_count"), count(F.col("excluded_from_retrieval")).alias("excluded_count"),
    )
    warned = (flag_warnings(blocks) if warnings is None else first_warnings(warnings)).groupBy("document_id").agg(F.count("*").alias("warning_count"))
    out = _every(documents, out).join(warned, "document_id", "left").fillna(0, ["warning_count", "block_count", "table_count", "image_count", "ocr_candidate_count", "excluded_count"])
    return out if raw_counts is None else out.join(raw_counts, "document_id", "left")


def block_reviews(blocks: DataFrame) -> DataFrame:
    """A review item for each occurrence of a flag that asks for one."""
    kinds = F.create_map(*(F.lit(x) for flag, kind, _ in REVIEWS for x in (flag, kind)))
    why = F.create_map(*(F.lit(x) for flag, _, reason in REVIEWS for x in (flag, reason)))
    rows = blocks.select("document_id", "block_id", "page_start", "text", "table_data", "image", F.explode("quality_flags").alias("flag")).where(F.col("flag").isin(*(r[0] for r in REVIEWS)))
    return rows.select(
        short_sha1(F.col("document_id"), F.col("block_id"), F.col("flag"), prefix="review_").alias("review_id"), kinds[F.col("flag")].alias("review_type"), F.lit("warning").alias("severity"),
        "document_id", F.col("page_start").alias("page_number"), F.lit("block").alias("object_type"), F.col("block_id").alias("object_id"), why[F.col("flag")].alias("reason"), F.lit(ACTION).alias("suggested_action"), preview("text", "table_data", "image").alias("source_preview"), F.lit("pending").alias("status"),
    )


def evaluations(blocks: DataFrame, warnings: DataFrame | None = None, additional: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """One row a document, also for those without blocks if the documents are given: failed with errors, review_required
    with reviews or warnings, else finalized."""
    warned = flag_warnings(blocks) if warnings is None else first_warnings(warnings)
    levels = warned.groupBy("document_id").agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warning").alias("warning_count"))
    reviews = block_reviews(blocks).select("document_id", "review_id")
    if additional is not None:
        more = additional.select("document_id", "review_id")
        reviews = reviews.unionByName(more.join(reviews.select("review_id").distinct(), "review_id", "left_anti").select("document_id", "review_id"))
    asked = reviews.groupBy("document_id").agg(F.count("*").alias("review_count"))
    types = counts_by_type(blocks).groupBy("document_id").agg(F.sum("n").alias("block_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("block_type", "n")))).alias("blocks_by_type"))
    flags = flag_counts(blocks).groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("flag", "n")))).alias("quality_flags"))
    out = _every(documents, types).join(flags, "document_id", "left").join(levels, "document_id", "left").join(asked, "document_id", "left").fillna(0, ["block_count", "error_count", "warning_count", "review_count"])
    status = F.when(F.col("error_count") > 0, "failed").when((F.col("review_count") > 0) | (F.col("warning_count") > 0), "review_required").otherwise("finalized")
    return out.withColumn("status", status)


def batch_report(results: DataFrame) -> DataFrame:
    """One row: how many files ended in each state."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("total"), *(n(s) for s in ("finalized", "review_required", "failed", "cancelled")))
