"""Review tasks of OCR candidates: making them, running a provider, bulk actions, reports, and rebuilding one task's document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import review

#: What can be chosen before and after OCR ran.
BEFORE = ("run_ocr", "approve_native", "exclude_page", "reject_document")
AFTER = review.AFTER_OCR
RESULT = "candidate_id string, result string, error_type string"


class Provider(Protocol):
    """Gives the layout of a picture as JSON text; may raise."""

    def __call__(self, preview_path: str) -> str: ...


def execute(candidates: DataFrame, make_provider: Callable[[], Provider], concurrency: int = 2) -> DataFrame:
    """(candidate_id, result, error_type): a provider's answer for each candidate (candidate_id, preview_path).

    At most ``concurrency`` run at once, one provider each; a failure is a result and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            rows = []
            for candidate, path in zip(batch["candidate_id"], batch["preview_path"]):
                if not path:
                    rows.append((candidate, None, "OCR_ASSET_NOT_AVAILABLE"))
                    continue
                try:
                    rows.append((candidate, provider(path), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((candidate, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["candidate_id", "result", "error_type"])

    return candidates.select("candidate_id", "preview_path").repartition(concurrency).mapInPandas(run, RESULT)


def render(candidates: DataFrame, make_renderer: Callable[[], Callable[[str, int, int], str]], dpi: int = 144) -> DataFrame:
    """(candidate_id, preview_path, error_type): the picture of each candidate's page (candidate_id, source_path, page_number).

    No renderer is included: the caller gives one per task, called with path, page and dpi (scale is dpi / 72)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make_renderer()
        for batch in batches:
            rows = []
            for candidate, path, page in zip(batch["candidate_id"], batch["source_path"], batch["page_number"]):
                try:
                    rows.append((candidate, renderer(path, int(page), dpi), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((candidate, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["candidate_id", "preview_path", "error_type"])

    return candidates.select("candidate_id", "source_path", "page_number").mapInPandas(run, "candidate_id string, preview_path string, error_type string")


def create(candidates: DataFrame, run_id: str, results: DataFrame | None = None) -> DataFrame:
    """Tasks of candidates (candidate_id, document_id, page_number, decision, reason_codes, target_block_ids).

    With results, an answered candidate begins after OCR and suggests to approve it; a failed one says so among its reasons."""
    rows = candidates if results is None else candidates.join(results, "candidate_id", "left")
    if results is None:
        rows = rows.withColumn("result", F.lit(None).cast("string")).withColumn("error_type", F.lit(None).cast("string"))
    done = F.col("result").isNotNull()
    failed = F.when(F.col("error_type") == "OCR_ASSET_NOT_AVAILABLE", F.array(F.lit("OCR_ASSET_NOT_AVAILABLE"))).when(F.col("error_type").isNotNull(), F.array(F.lit("OCR_EXECUTION_FAILED"))).otherwise(F.array().cast("array<string>"))
    seed = F.substring(F.sha1(F.concat_ws("|", F.lit(run_id), "candidate_id")), 1, 8)
    listed = lambda names: F.array(*map(F.lit, names))
    return rows.select(
        F.concat_ws("_", F.lit("ocr_review"), "document_id", "candidate_id", seed).alias("review_id"), "document_id", "candidate_id", "page_number", F.when(done, "post_ocr").otherwise("pre_ocr").alias("review_stage"),
        F.concat("reason_codes", failed).alias("reason_codes"), F.when(done, "approve_ocr").when(F.col("decision") == "auto_ocr", "run_ocr").otherwise("approve_native").alias("suggested_action"),
        F.when(done, listed(AFTER)).otherwise(listed(BEFORE)).alias("allowed_actions"), "target_block_ids", F.lit(run_id).alias("run_id"), F.col("decision").alias("ocr_decision"),
    )


def bulk(states: DataFrame, reviewer: str, action: str = "run_ocr") -> DataFrame:
    """A decision for every pending task that allows the action."""
    ok = (F.col("status") == "pending") & F.array_contains("allowed_actions", action)
    return states.where(ok).select("review_id", F.lit(action).alias("selected_action"), F.lit(reviewer).alias("reviewer"))


def executable(states: DataFrame, executing: DataFrame | None = None) -> DataFrame:
    """Tasks whose OCR was asked for and isn't running."""
    rows = states.where("status = 'ocr_requested'")
    return rows if executing is None else rows.join(executing.select("review_id").distinct(), "review_id", "left_anti")


def report(tasks: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """One row: candidates, tasks, answers, failures."""
    counts = tasks.agg(F.countDistinct("candidate_id").alias("candidate_count"), F.count("*").alias("review_task_count"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("executed_count", "failure_count")]
    if results is None:
        return counts.select("*", *none)
    done = results.agg(F.count("result").alias("executed_count"), F.count("error_type").alias("failure_count"))
    both = counts.unionByName(done, allowMissingColumns=True)
    return both.agg(*(F.sum(c).alias(c) for c in ("candidate_count", "review_task_count", "executed_count", "failure_count")))


def by_run(states: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks of each run with its file: counts by state and the pages in order, nulls last."""
    rows = states.join(files.select("document_id", "filename"), "document_id", "left")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    pages = F.array_sort(F.collect_set("page_number"))
    return rows.groupBy("run_id").agg(F.first("filename", ignorenulls=True).alias("filename"), F.count("*").alias("tasks"), pages.alias("pages"), *(n(s) for s in ("pending", "ocr_requested", "ocr_result_ready", "decided", "applied")))


def rebuild(blocks: DataFrame, task: DataFrame, replacement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of each task's document after it alone is applied, tasks that can't be: their page lies inside a block over
    several pages, or a target block isn't there).

    task: review_id, document_id, page_number, target_block_ids; replacement carries review_id."""
    wide = task.select("review_id", "document_id", "page_number", F.coalesce("target_block_ids", F.array().cast("array<string>")).alias("targets"))
    rows = wide.join(blocks, "document_id")
    by_id = F.size("targets") > 0
    inside = ~by_id & (F.coalesce("page_start", F.lit(0)) < F.col("page_number")) & (F.col("page_number") < F.coalesce("page_end", F.lit(0)))
    stop = rows.groupBy("review_id").agg(F.max(inside).alias("inside"), F.collect_set(F.when(F.array_contains("targets", F.col("block_id")), F.col("block_id"))).alias("there"), F.first("targets").alias("targets"))
    reason = F.when(F.size(F.array_except("targets", "there")) > 0, "target_blocks_not_found").when(F.col("inside"), "target_page_is_inside_cross_page_block")
    stopped = stop.withColumn("reason", reason).where("reason is not null").select("review_id", "reason")
    replaced = F.when(by_id, F.array_contains("targets", F.col("block_id"))).otherwise(review.contains_page(F.col("page_number"), end="zero"))
    kept = rows.join(stopped, "review_id", "left_anti").where(~replaced).drop("targets", "page_number")
    new = replacement.join(stopped, "review_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), stopped
