"""Append-only review logs: latest decisions, task states, applying decisions, finalising runs.

Logs carry ``seq``, the order of appending; the latest record is the one of highest seq, whatever its clock says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reviewer can choose, and what asks for OCR.
ACTIONS = ("run_ocr", "approve_native", "approve_ocr", "merge_results", "retry_ocr", "exclude_page", "reject_document")
ASKS_OCR = ("run_ocr", "retry_ocr")
STRUCTURE_ACTIONS = ("approve", "correct_text", "exclude_block", "reject_document")
STRUCTURE_TYPES = ("cross_page_paragraph", "continued_table")
OCR_FLAGS = ("manual_review", "auto_ocr_candidate", "review_before_ocr", "auto_ocr")


#: What can be chosen once OCR has run.
AFTER_OCR = ("approve_native", "approve_ocr", "merge_results", "retry_ocr", "exclude_page", "reject_document")


def _blank(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+", "") == ""


def latest(log: DataFrame, key: str = "review_id", order: str = "seq") -> DataFrame:
    """The last appended record of each key; one pass with a partial maximum before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def decision_errors(decisions: DataFrame, ocr_counts: bool = False) -> DataFrame:
    """decisions with errors: an action that is unknown or that the task (allowed_actions, where the column is there) doesn't
    allow, no reviewer, a merge without ids, OCR asked of nothing."""
    own = F.array_contains("allowed_actions", F.col("selected_action")) if "allowed_actions" in decisions.columns else F.lit(True)
    ids = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) if c in decisions.columns else F.lit(False)
    bad = F.array(
        F.when(~F.coalesce(F.col("selected_action").isin(*ACTIONS) & own, F.lit(False)), "action is not allowed"),
        F.when(_blank("reviewer"), "reviewer is required"),
        F.when((F.col("selected_action") == "merge_results") & ~ids("native_block_ids") & ~ids("ocr_block_ids"), "merge_results needs block ids"),
        *([F.when(F.col("selected_action").isin("approve_ocr", "merge_results", "retry_ocr") & (F.coalesce("ocr_block_count", F.lit(0)) == 0), "no OCR blocks")] if ocr_counts else []),
    )
    return decisions.withColumn("errors", F.array_compact(bad))


def structure_errors(decisions: DataFrame) -> DataFrame:
    bad = F.array(
        F.when(~F.coalesce(F.col("selected_action").isin(*STRUCTURE_ACTIONS), F.lit(False)), "action is not allowed"),
        F.when(_blank("reviewer"), "reviewer is required"),
        F.when((F.col("selected_action") == "correct_text") & _blank("corrected_text"), "corrected_text is required"),
    )
    return decisions.withColumn("errors", F.array_compact(bad))


def task_states(tasks: DataFrame, decisions: DataFrame, results: DataFrame | None = None, applied: DataFrame | None = None) -> DataFrame:
    """tasks (review_id, ...) with the latest decision and result, and status.

    pending without a decision; applied if (review_id, decision_id) was applied; after run_ocr or retry_ocr
    ocr_result_ready if the latest result answers this decision, else ocr_requested; else decided.
    """
    d = latest(decisions).select("review_id", "decision_id", "selected_action", F.col("seq").alias("decision_seq"))
    out = tasks.join(d, "review_id", "left")
    if results is None:
        out = out.withColumn("answered", F.lit(None).cast("string"))
    else:
        out = out.join(latest(results).select("review_id", F.col("requested_decision_id").alias("answered")), "review_id", "left")
    if applied is None:
        out = out.withColumn("is_applied", F.lit(False))
    else:
        out = out.join(applied.select("review_id", "decision_id").distinct().withColumn("is_applied", F.lit(True)), ["review_id", "decision_id"], "left")
    asks = F.col("selected_action").isin(*ASKS_OCR)
    status = (
        F.when(F.col("decision_id").isNull(), "pending").when(F.coalesce("is_applied", F.lit(False)), "applied")
        .when(asks & (F.col("answered") == F.col("decision_id")), "ocr_result_ready").when(asks, "ocr_requested").otherwise("decided")
    )
    stage = F.when(F.col("answered").isNotNull(), "post_ocr").otherwise("pre_ocr")
    if "allowed_actions" in tasks.columns:
        out = out.withColumn("allowed_actions", F.when(F.col("answered").isNotNull(), F.array(*map(F.lit, AFTER_OCR))).otherwise(F.col("allowed_actions")))
    return out.withColumn("status", status).withColumn("review_stage", stage).drop("answered", "is_applied")


def create_tasks(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks to insert, tasks refused because their id is there or comes twice)."""
    n = Window.partitionBy("review_id")
    marked = new.withColumn("__n", F.row_number().over(n.orderBy("created_at"))).join(existing.select("review_id").distinct().withColumn("__old", F.lit(True)), "review_id", "left")
    ok = (F.col("__n") == 1) & F.col("__old").isNull()
    return marked.where(ok).drop("__n", "__old"), marked.where(~ok).drop("__n", "__old")


def progress(states: DataFrame, by: str = "document_id") -> DataFrame:
    """Counts of tasks by state, and the pages that are applied or decided, each once and in order."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return states.groupBy(by).agg(F.count("*").alias("tasks"), *(n(s) for s in ("pending", "ocr_requested", "ocr_result_ready", "decided", "applied")), F.sort_array(F.collect_set(F.when(F.col("status") == "applied", F.col("page_number")))).alias("applied_pages"))


def contains_page(page: Column, end: str = "start") -> Column:
    """page_start <= page <= page_end; a null end is the start, or with end='zero' page 0."""
    last = F.coalesce("page_end", F.col("page_start") if end == "start" else F.lit(0))
    return F.coalesce((F.col("page_start") <= page) & (page <= last), F.lit(False))


def mark_final(blocks: DataFrame, source: str) -> DataFrame:
    """Blocks approved from a source: decision noted, flags about OCR removed wherever they stand, others kept with repeats."""
    flags = F.filter(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda f: ~f.isin(*OCR_FLAGS))
    return blocks.withColumn("final_source", F.lit(source)).withColumn("ocr_decision", F.lit(f"approved_{source}")).withColumn("quality_flags", flags)


def review_order(blocks: DataFrame, number: str = "block_order") -> DataFrame:
    """Numbers blocks 1.. within their document by page, top and left edge, all nulls as 0, then order."""
    box = lambda i: F.coalesce(F.get("bbox", F.lit(i)), F.lit(0.0))
    w = Window.partitionBy("document_id").orderBy(F.coalesce("page_start", F.lit(0)), box(1), box(0), "block_order", "block_id")
    return blocks.withColumn(number, F.row_number().over(w))


def remap_ocr(ocr_blocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """OCR blocks (review_id, pos, ...) under the ids of their task's document: {doc}_p0001_ocr_review_0001 and so on."""
    rows = ocr_blocks.drop("document_id", "page_start").join(tasks.select("review_id", "document_id", F.col("page_number").alias("page_start"), F.coalesce("anchor_order", F.lit(0)).alias("anchor_order")), "review_id")
    i = F.row_number().over(Window.partitionBy("review_id").orderBy("pos"))
    where = F.when(F.col("page_start").isNotNull(), F.format_string("p%04d", F.coalesce("page_start", F.lit(0)))).otherwise(F.substring("review_id", -12, 12))
    rows = rows.withColumn("i", i)
    return rows.withColumn("block_id", F.concat_ws("_", "document_id", where, F.lit("ocr_review"), F.format_string("%04d", "i"))).withColumn("block_order", F.col("anchor_order") + F.col("i")).drop("i", "anchor_order")


def apply_decisions(states: DataFrame, native: DataFrame, ocr: DataFrame) -> DataFrame:
    """The blocks each decided task leaves: the native ones, the OCR ones, the chosen ones of both ('all' chooses all), or none.

    states: review_id, document_id, page_number, selected_action, native_block_ids, ocr_block_ids; native and ocr carry review_id."""
    chosen = lambda ids: F.coalesce(F.array_contains(ids, "all") | F.array_contains(ids, F.col("block_id")), F.lit(False))
    pick = states.select("review_id", "selected_action", "native_block_ids", "ocr_block_ids")
    n = native.join(pick, "review_id").where((F.col("selected_action") == "approve_native") | (F.col("selected_action") == "merge_results") & chosen(F.col("native_block_ids")))
    o = ocr.join(pick, "review_id").where((F.col("selected_action") == "approve_ocr") | (F.col("selected_action") == "merge_results") & chosen(F.col("ocr_block_ids")))
    tidy = lambda df, src: mark_final(df, src).drop("selected_action", "native_block_ids", "ocr_block_ids")
    return tidy(n, "native").unionByName(tidy(o, "ocr"), allowMissingColumns=True)


def record_results(decisions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(OCR results to append, refused answers with a reason).

    answers: review_id, provider, provider_result_path, ocr_blocks_path, paths_exist.  A result needs a latest decision that
    asks for OCR, and both files; it carries the decision it answers."""
    last = latest(decisions).select("review_id", "decision_id", "selected_action")
    rows = answers.join(last, "review_id", "left")
    reason = F.when(~F.coalesce(F.col("selected_action").isin(*ASKS_OCR), F.lit(False)), "no_ocr_requested").when(~F.coalesce("paths_exist", F.lit(False)), "files_missing")
    rows = rows.withColumn("reason", reason)
    result_id = F.concat(F.lit("ocr_result_"), F.substring(F.sha1(F.concat_ws("|", "review_id", "decision_id", "provider_result_path")), 1, 12))
    ok = rows.where("reason is null").select(result_id.alias("ocr_result_id"), "review_id", F.col("decision_id").alias("requested_decision_id"), "provider", "provider_result_path", "ocr_blocks_path")
    return ok, rows.where("reason is not null").select("review_id", "reason")


def finalization_id(ids: Column) -> Column:
    return F.concat(F.lit("final_"), F.substring(F.sha2(F.array_join(F.sort_array(ids), "|"), 256), 1, 12))


def run_status(states: DataFrame) -> DataFrame:
    """(document_id, run_status, finalization_id): pending_reviews until every task is applied, blocked with a rejection, else completed."""
    rejected = F.max(F.col("selected_action") == "reject_document")
    open_ = F.max(~F.coalesce(F.col("status") == "applied", F.lit(False)))
    status = F.when(open_, "pending_reviews").when(F.coalesce(rejected, F.lit(False)), "blocked").otherwise("completed")
    return states.groupBy("document_id").agg(status.alias("run_status"), finalization_id(F.collect_list("decision_id")).alias("finalization_id"))


def _replacing(states: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tasks of completed runs that replace something: by page (document_id, review_id, page), by block (document_id, review_id, block_id)."""
    targets = F.coalesce("target_block_ids", F.array().cast("array<string>")) if "target_block_ids" in states.columns else F.array().cast("array<string>")
    rows = states.withColumn("__t", targets).where("selected_action <> 'approve_native'").join(completed.select("document_id"), "document_id", "left_semi")
    by_page = rows.where("size(__t) = 0").select("document_id", "review_id", F.col("page_number").alias("__page"))
    return by_page, rows.where("size(__t) > 0").select("document_id", "review_id", F.explode("__t").alias("block_id")).distinct()


def finalization(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """(document_id, run_status, reason, finalization_id) of each run: blocked with a rejection or where a decided page cuts a
    block over several pages, error where target blocks are missing or replaced twice or a task names neither page nor block."""
    runs = run_status(states)
    by_page, by_block = _replacing(states, runs.where("run_status = 'completed'"))
    mark = lambda rows, reason: rows.select("document_id", F.lit(reason).alias("reason"))
    missing = by_block.join(blocks.select("document_id", "block_id"), ["document_id", "block_id"], "left_anti")
    twice = by_block.groupBy("document_id", "block_id").agg(F.countDistinct("review_id").alias("n")).where("n > 1")
    wide = blocks.where("page_end > page_start").select("document_id", "page_start", "page_end")
    cut = by_page.join(wide, "document_id").where(contains_page(F.col("__page")))
    found = mark(missing, "1target_blocks_missing").unionAll(mark(twice, "2target_blocks_replaced_twice")).unionAll(mark(by_page.where("__page is null"), "3no_page_and_no_target")).unionAll(mark(cut, "4reviewed_page_intersects_cross_page_block"))
    worst = found.groupBy("document_id").agg(F.min("reason").alias("reason"))
    out = runs.join(worst, "document_id", "left")
    rejected = F.when(F.col("run_status") == "blocked", F.lit("document_rejected_by_review"))
    status = F.when(F.col("reason").isNull(), F.col("run_status")).when(F.col("reason").startswith("4"), "blocked").otherwise("error")
    return out.select("document_id", status.alias("run_status"), F.coalesce(F.substring("reason", 2, 99), rejected).alias("reason"), "finalization_id")


def finalize(blocks: DataFrame, states: DataFrame, replacements: DataFrame) -> DataFrame:
    """The blocks of completed runs: those that no decision replaces, by page or by id, and the replacements, in review order.

    replacements carry review_id; approve_native replaces nothing.  Of several tasks that replace one page that of the
    greatest review_id counts.  Runs with a reason against them (see finalization) give nothing."""
    done = finalization(blocks, states).where("run_status = 'completed'").select("document_id")
    by_page, by_block = _replacing(states, done)
    ours = blocks.join(done, "document_id", "left_semi").join(by_block.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")
    page = by_page.select(F.col("document_id").alias("__d"), "__page").distinct()
    kept = ours.join(page, (F.col("document_id") == F.col("__d")) & contains_page(F.col("__page")), "left_anti")
    chosen = by_page.groupBy("document_id", "__page").agg(F.max("review_id").alias("review_id")).select("review_id").unionAll(by_block.select("review_id")).distinct()
    new = replacements.join(chosen, "review_id", "left_semi").join(done, "document_id", "left_semi")
    return review_order(kept.unionByName(new, allowMissingColumns=True))


def structure_tasks(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items of the two structure types that have no task yet."""
    return items.where(F.col("review_type").isin(*STRUCTURE_TYPES)).dropDuplicates(["review_id"]).join(existing.select("review_id").distinct(), "review_id", "left_anti")


def apply_structure(blocks: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Blocks after structure decisions: corrected text (the old one kept), exclusion, the flag under review removed."""
    flag = F.create_map(F.lit("cross_page_paragraph"), F.lit("merged_cross_page_paragraph"), F.lit("continued_table"), F.lit("merged_continued_table"))
    d = tasks.join(latest(decisions), "review_id").select("review_id", F.col("object_id").alias("block_id"), flag[F.col("review_type")].alias("flag"), "selected_action", "corrected_text")
    per = d.groupBy("block_id").agg(F.collect_set("flag").alias("__flags"), F.max(F.when(F.col("selected_action") == "correct_text", F.col("corrected_text"))).alias("__text"), F.max(F.col("selected_action") == "exclude_block").alias("__out"))
    out = blocks.join(per, "block_id", "left")
    return (
        out.withColumn("original_text", F.when(F.col("__text").isNotNull(), F.col("text"))).withColumn("text", F.coalesce("__text", "text"))
        .withColumn("excluded_from_retrieval", F.coalesce("__out", F.lit(False)) | F.coalesce("excluded_from_retrieval", F.lit(False)))
        .withColumn("quality_flags", F.filter("quality_flags", lambda f: ~F.coalesce(F.array_contains("__flags", f), F.lit(False)))).drop("__flags", "__text", "__out")
    )


def structure_finalization(blocks: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(document_id, run_status, reason, finalization_id) of each document under structure review: pending_reviews until all
    tasks are decided, blocked with a rejection, error where a reviewed block isn't there, else completed."""
    last = latest(decisions).select("review_id", "decision_id", "selected_action")
    rows = tasks.select("review_id", "document_id", F.col("object_id").alias("block_id")).join(last, "review_id", "left")
    rows = rows.join(blocks.select("block_id").distinct().withColumn("__there", F.lit(True)), "block_id", "left")
    out = rows.groupBy("document_id").agg(
        F.max(F.col("decision_id").isNull()).alias("open"), F.max(F.coalesce(F.col("selected_action") == "reject_document", F.lit(False))).alias("rejected"), F.max(F.col("__there").isNull()).alias("missing"), finalization_id(F.collect_list("decision_id")).alias("finalization_id")
    )
    status = F.when(F.col("open"), "pending_reviews").when(F.col("rejected"), "blocked").when(F.col("missing"), "error").otherwise("completed")
    reason = F.when(F.col("open"), F.lit(None).cast("string")).when(F.col("rejected"), "document_rejected_by_structure_review").when(F.col("missing"), "reviewed_block_not_found")
    return out.select("document_id", status.alias("run_status"), reason.alias("reason"), "finalization_id")


def finalize_structure(blocks: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """The blocks of documents whose structure review is completed, decisions applied; nothing is cleaned or repaired again."""
    done = structure_finalization(blocks, tasks, decisions).where("run_status = 'completed'").select("document_id")
    return apply_structure(blocks.join(done, "document_id", "left_semi"), tasks, decisions)


def queue(states: DataFrame) -> DataFrame:
    """The queue as reviewers see it."""
    return states.where(F.col("status").isin("pending", "ocr_requested", "ocr_result_ready")).select("review_id", "document_id", "page_number", "status", "review_stage")
