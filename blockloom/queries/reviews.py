"""Queries of review logs, revisions and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import export, review, revisions, tasks, validate
from blockloom.queries.text import B, D, blocks, documents
from blockloom.tables import table


def _log(spark, sf):
    """The log of decisions, each record once."""
    log = table(spark, sf, "ocr_decisions")
    return log.groupBy("seq").agg(F.min_by(F.struct(*log.columns), "received_at").alias("r")).select("r.*")


def _tasks(spark, sf):
    """A task for every review of the log."""
    log = table(spark, sf, "ocr_decisions")
    return log.groupBy("review_id").agg(F.min("document_id").alias("document_id"), F.min("page_number").alias("page_number"))


def _in_time(log):
    return log.where("received_at <= decided_at + interval 1 day")


def _results(spark, sf):
    """An OCR result for every decision that asked for one and came in time."""
    return _in_time(_log(spark, sf)).where("selected_action in ('run_ocr', 'retry_ocr')").select("review_id", "seq", F.col("decision_id").alias("requested_decision_id"))


def _applied(spark, sf):
    """Decisions that came in time are applied, OCR asked for counts as applied once it is there."""
    return _in_time(_log(spark, sf)).where("selected_action not in ('retry_ocr')").select("review_id", "decision_id")


def _states(spark, sf):
    return review.task_states(_tasks(spark, sf), _log(spark, sf), _results(spark, sf), _applied(spark, sf))


def latest_decision(spark, sf):
    return review.latest(_log(spark, sf)).select("review_id", "decision_id", "selected_action", F.col("seq").cast("bigint").alias("seq"))


def task_states(spark, sf):
    return _states(spark, sf).select("review_id", "status", "review_stage")


def review_progress(spark, sf):
    out = review.progress(_states(spark, sf))
    return out.select("document_id", *(F.col(c).cast("bigint").alias(c) for c in ("tasks", "pending", "ocr_requested", "ocr_result_ready", "decided", "applied")), F.array_join(F.transform("applied_pages", lambda p: p.cast("string")), ",").alias("applied_pages"))


def review_queue(spark, sf):
    return review.queue(_states(spark, sf)).select("review_id", "status")


def decision_errors(spark, sf):
    # Some records without a reviewer or with an action nobody may choose.
    log = _log(spark, sf).withColumn("reviewer", F.when(F.col("seq") % 10 == 0, " ").otherwise(F.col("reviewer"))).withColumn("selected_action", F.when(F.col("seq") % 7 == 0, "delete").otherwise(F.col("selected_action")))
    return review.decision_errors(log).select("decision_id", F.explode("errors").alias("error"))


def run_status(spark, sf):
    return review.run_status(_states(spark, sf))


def new_tasks(spark, sf):
    tasks = _tasks(spark, sf).withColumn("created_at", F.col("page_number"))
    existing = tasks.where("page_number = 1")
    return review.create_tasks(existing, tasks.unionByName(tasks.where("page_number = 2")))[0].select("review_id")


def refused_tasks(spark, sf):
    tasks = _tasks(spark, sf).withColumn("created_at", F.col("page_number"))
    existing = tasks.where("page_number = 1")
    return review.create_tasks(existing, tasks.unionByName(tasks.where("page_number = 2")))[1].select("review_id")


def applied_blocks(spark, sf):
    d = review.latest(_log(spark, sf)).select("review_id", "document_id", "selected_action", "native_block_ids", F.array(F.lit("all")).alias("ocr_block_ids"), "page_number")
    pages = d.select("review_id", "document_id", F.col("page_number").alias("page_start"))
    native = blocks(spark, sf).select("document_id", "block_id", "page_start", "quality_flags").join(pages, ["document_id", "page_start"])
    ocr = native.withColumn("block_id", F.concat("block_id", F.lit("_ocr")))
    out = review.apply_decisions(d.drop("document_id", "page_number"), native, ocr)
    return out.select("review_id", "block_id", "final_source")


def _final_states(spark, sf):
    """States whose merged tasks name the blocks they replace; the others replace their page."""
    ids = review.latest(_log(spark, sf)).select("review_id", F.when(F.col("selected_action") == "merge_results", F.col("native_block_ids")).alias("target_block_ids"))
    return _states(spark, sf).join(ids, "review_id", "left")


def run_finalization(spark, sf):
    return review.finalization(blocks(spark, sf), _final_states(spark, sf)).select("document_id", "run_status", "reason")


def finalized_blocks(spark, sf):
    states = _final_states(spark, sf)
    new = states.where("selected_action in ('approve_ocr', 'merge_results')").select("document_id", "review_id", F.concat("review_id", F.lit("_new")).alias("block_id"), F.lit("paragraph").alias("block_type"), F.lit("as read").alias("text"), F.col("page_number").alias("page_start"), F.lit(0).alias("block_order"))
    return review.finalize(blocks(spark, sf), states, new).select("block_id", F.col("block_order").cast("bigint").alias("block_order"))


def _answers(spark, sf):
    """One answer of a provider for every review; where the reviewer left no note its files are missing."""
    return _log(spark, sf).groupBy("review_id").agg(F.max(F.coalesce(F.col("review_note") != "", F.lit(False))).alias("paths_exist")).select("review_id", F.lit("p").alias("provider"), F.concat("review_id", F.lit(".json")).alias("provider_result_path"), F.concat("review_id", F.lit("_blocks.json")).alias("ocr_blocks_path"), "paths_exist")


def recorded_results(spark, sf):
    return review.record_results(_log(spark, sf), _answers(spark, sf))[0].select("review_id", "requested_decision_id", "ocr_blocks_path")


def refused_results(spark, sf):
    return review.record_results(_log(spark, sf), _answers(spark, sf))[1]


def bulk_decisions(spark, sf):
    states = documents(spark, sf).select(F.concat(F.lit("r_"), "document_id").alias("review_id"), F.when(F.col("lang").isNull(), "decided").otherwise("pending").alias("status"), F.when(F.col("file_type") == "pdf", F.array(*map(F.lit, tasks.BEFORE))).otherwise(F.array(F.lit("approve_native"))).alias("allowed_actions"))
    return tasks.bulk(states, "me")


def executable_tasks(spark, sf):
    running = _log(spark, sf).where("reviewer = 'none'").select("review_id")
    return tasks.executable(_states(spark, sf), running).select("review_id")


def tasks_by_run(spark, sf):
    files = table(spark, sf, "parsed_documents").groupBy("document_id").agg(F.min("source_path").alias("filename"))
    states = _states(spark, sf).withColumn("run_id", F.col("document_id"))
    return tasks.by_run(states, files).select("run_id", "filename", "tasks", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "applied")


def task_violations(spark, sf):
    rows = review.latest(_log(spark, sf)).withColumnRenamed("native_block_ids", "target_block_ids").withColumn("allowed_actions", F.array(*map(F.lit, tasks.BEFORE))).withColumn("suggested_action", F.col("selected_action"))
    return validate.task_violations(rows)


def loaded_revisions(spark, sf):
    revs = _revisions(spark, sf)
    docs = revs.select("revision_id", "document_id")
    judged = docs.select("revision_id", "document_id", F.when(F.col("revision_id").startswith("base_"), "review_required").otherwise("finalized").alias("status"), F.lit(0).alias("error_count"), F.array(F.lit("applied")).alias("item_statuses"))
    return revisions.load_effective(revs, docs, judged)


def _new_side(spark, sf):
    """The blocks after a second parse: list items under other ids, longer headings."""
    b = blocks(spark, sf)
    return b.withColumn("block_id", F.when(F.col("block_type") == "list_item", F.concat("block_id", F.lit("_b"))).otherwise(F.col("block_id"))).withColumn("text", F.when(F.col("block_type") == "heading", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("block_type", F.when(F.col("heading_level") > 2, "paragraph").otherwise(F.col("block_type")))


def pair_types(spark, sf):
    out = revisions.types_of_pairs(blocks(spark, sf), _new_side(spark, sf))
    return out.select("document_id", F.array_join("block_types", ",").alias("block_types"))


def _structure(spark, sf):
    """A task for each block under structure review; decisions by what the block is."""
    b = blocks(spark, sf).where("array_contains(quality_flags, 'merged_cross_page_paragraph')")
    tasks_ = b.select("document_id", F.concat(F.lit("s_"), "block_id").alias("review_id"), F.col("block_id").alias("object_id"), F.lit("cross_page_paragraph").alias("review_type"))
    action = F.when(F.col("page_start") == 1, "approve").when(F.col("page_start") == 2, "correct_text").when(F.col("page_start") == 3, "exclude_block").otherwise("reject_document")
    decided = b.where("length(text) > 60").select(F.concat(F.lit("s_"), "block_id").alias("review_id"), F.concat(F.lit("d_"), "block_id").alias("decision_id"), F.col("block_order").alias("seq"), action.alias("selected_action"), F.concat(F.lit("corrected "), "text").alias("corrected_text"))
    return tasks_, decided


def structure_final(spark, sf):
    return review.structure_finalization(blocks(spark, sf), *_structure(spark, sf))


def structure_final_blocks(spark, sf):
    return review.finalize_structure(blocks(spark, sf), *_structure(spark, sf)).select("block_id", "text", "excluded_from_retrieval")


def structure_result(spark, sf):
    b = blocks(spark, sf).where("array_contains(quality_flags, 'merged_cross_page_paragraph')")
    tasks = b.select(F.concat(F.lit("s_"), "block_id").alias("review_id"), F.col("block_id").alias("object_id"), F.lit("cross_page_paragraph").alias("review_type"))
    action = F.when(F.col("block_order") % 3 == 0, "approve").when(F.col("block_order") % 3 == 1, "correct_text").otherwise("exclude_block")
    decisions = b.select(F.concat(F.lit("s_"), "block_id").alias("review_id"), F.col("block_order").alias("seq"), action.alias("selected_action"), F.concat(F.lit("corrected "), "text").alias("corrected_text"))
    out = review.apply_structure(blocks(spark, sf), tasks, decisions)
    return out.select("block_id", "text", "excluded_from_retrieval", F.array_join("quality_flags", ",").alias("flags"))


def _revisions(spark, sf):
    s = review.run_status(_states(spark, sf))
    base = s.select("document_id", F.lit("base_run").alias("source"), F.concat(F.lit("base_"), "document_id").alias("revision_id"), F.lit(None).cast("string").alias("base_revision_id"), F.lit("completed").alias("status"), F.lit(1).alias("seq"))
    ocr = s.select("document_id", F.lit("ocr_review").alias("source"), F.col("finalization_id").alias("revision_id"), F.concat(F.lit("base_"), "document_id").alias("base_revision_id"), F.col("run_status").alias("status"), F.lit(2).alias("seq"))
    manual = s.where("right(document_id, 1) in ('0', '2', '4', '6', '8', 'a')").select("document_id", F.lit("manual_revision").alias("source"), F.concat(F.lit("manual_"), "document_id").alias("revision_id"), F.when(F.expr("right(document_id, 1) in ('0', '4', '8')"), F.col("finalization_id")).otherwise(F.concat(F.lit("base_"), "document_id")).alias("base_revision_id"), F.lit("completed").alias("status"), F.lit(3).alias("seq"))
    return base.unionByName(ocr).unionByName(manual)


def effective_revision(spark, sf):
    return revisions.effective(_revisions(spark, sf))


def block_difference(spark, sf):
    out = revisions.difference(blocks(spark, sf), _new_side(spark, sf), ["text", "page_start"])
    return out.select("block_id", "change", F.col("rank").cast("bigint").alias("rank"))


def amended_blocks(spark, sf):
    b = blocks(spark, sf)
    include = b.where("excluded_from_retrieval and block_order % 2 = 0").select("document_id", "block_id")
    additions = b.where("block_order = 1 and page_start is not null").select("document_id", F.lit(1).alias("seq"), F.col("page_start").alias("page"), F.lit("added").alias("text"))
    out = revisions.amend(b, include, additions)
    return out.select("block_id", F.coalesce("excluded_from_retrieval", F.lit(False)).alias("excluded"), F.col("block_order").cast("bigint").alias("block_order"))


def missing_ids(spark, sf):
    named = _log(spark, sf).select(F.explode("native_block_ids").alias("block_id")).distinct()
    return revisions.missing(named, blocks(spark, sf))


def history_search(spark, sf):
    f = table(spark, sf, "source_files").withColumn("job_id", F.concat(F.lit("job_"), F.coalesce("site", F.lit("none"))))
    files = F.sort_array(F.collect_list(F.struct("source_id", F.col("original_filename").alias("filename"), F.when(F.col("source_id") % 3 == 0, "failed").otherwise("finalized").alias("status"))))
    jobs = f.groupBy("job_id").agg(F.min("received_at").alias("created_at"), files.alias("files"))
    return export.search_history(jobs, "REPORT", "failed").select("job_id", F.col("index").cast("bigint").alias("index"), "filename")


QUERIES = {
    f.__name__: f
    for f in (
        latest_decision, task_states, review_progress, review_queue, decision_errors, run_status, new_tasks, refused_tasks, applied_blocks, finalized_blocks, structure_result,
        effective_revision, block_difference, amended_blocks, missing_ids, history_search, run_finalization, recorded_results, refused_results, bulk_decisions, executable_tasks, tasks_by_run,
        task_violations, loaded_revisions, pair_types, structure_final, structure_final_blocks,
    )
}

_L = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY received_at) AS rn FROM ocr_decisions) WHERE rn = 1)"
_LAST = "la AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) AS rn FROM l) WHERE rn = 1)"
_T = "t AS (SELECT review_id, min(document_id) AS document_id, min(page_number) AS page_number FROM ocr_decisions GROUP BY 1)"
_S = f"""{_L}, {_LAST}, {_T}, rs AS (SELECT review_id, arg_max(decision_id, seq) AS answered FROM l WHERE selected_action IN ('run_ocr', 'retry_ocr') AND received_at <= decided_at + INTERVAL 1 DAY GROUP BY 1),
    s AS (SELECT t.review_id, t.document_id, t.page_number, la.decision_id, la.selected_action, la.native_block_ids, CASE WHEN la.decision_id IS NULL THEN 'pending' WHEN la.selected_action <> 'retry_ocr' AND la.received_at <= la.decided_at + INTERVAL 1 DAY THEN 'applied'
        WHEN la.selected_action IN ('run_ocr', 'retry_ocr') THEN CASE WHEN rs.answered = la.decision_id THEN 'ocr_result_ready' ELSE 'ocr_requested' END ELSE 'decided' END AS status, CASE WHEN rs.answered IS NOT NULL THEN 'post_ocr' ELSE 'pre_ocr' END AS review_stage
        FROM t LEFT JOIN la USING (review_id) LEFT JOIN rs USING (review_id))"""
_R = """r AS (SELECT document_id, CASE WHEN bool_or(status <> 'applied') THEN 'pending_reviews' WHEN bool_or(coalesce(selected_action = 'reject_document', false)) THEN 'blocked' ELSE 'completed' END AS run_status,
    'final_' || substr(sha256(string_agg(decision_id, '|' ORDER BY decision_id)), 1, 12) AS finalization_id FROM s GROUP BY 1)"""
_FINAL = """c AS (SELECT s.*, CASE WHEN selected_action = 'merge_results' THEN native_block_ids END AS tg FROM s JOIN r USING (document_id) WHERE run_status = 'completed' AND selected_action <> 'approve_native'),
    pg AS (SELECT document_id, review_id, page_number FROM c WHERE coalesce(len(tg), 0) = 0), ti AS (SELECT DISTINCT document_id, review_id, block_id FROM (SELECT document_id, review_id, unnest(tg) AS block_id FROM c)),
    bad AS (SELECT document_id, 1 AS k FROM ti WHERE (document_id, block_id) NOT IN (SELECT document_id, block_id FROM b) UNION ALL SELECT document_id, 2 FROM ti GROUP BY document_id, block_id HAVING count(*) > 1
        UNION ALL SELECT document_id, 3 FROM pg WHERE page_number IS NULL UNION ALL SELECT document_id, 4 FROM pg JOIN b USING (document_id) WHERE page_end > page_start AND page_number BETWEEN page_start AND page_end),
    fin AS (SELECT document_id, CASE k WHEN 4 THEN 'blocked' ELSE CASE WHEN k IS NULL THEN run_status ELSE 'error' END END AS run_status,
        CASE k WHEN 1 THEN 'target_blocks_missing' WHEN 2 THEN 'target_blocks_replaced_twice' WHEN 3 THEN 'no_page_and_no_target' WHEN 4 THEN 'reviewed_page_intersects_cross_page_block' ELSE CASE WHEN run_status = 'blocked' THEN 'document_rejected_by_review' END END AS reason
        FROM r LEFT JOIN (SELECT document_id, min(k) AS k FROM bad GROUP BY 1) USING (document_id))"""
_ANSWERS = "an AS (SELECT review_id, bool_or(coalesce(review_note <> '', false)) AS there FROM l GROUP BY 1)"
_NEW_ID = "CASE WHEN block_type = 'list_item' THEN block_id || '_b' ELSE block_id END"
_STRUCTURE = """st AS (SELECT document_id, block_id, CASE WHEN length(text) > 60 THEN 'd_' || block_id END AS did, CASE WHEN length(text) > 60 THEN CASE page_start WHEN 1 THEN 'approve' WHEN 2 THEN 'correct_text' WHEN 3 THEN 'exclude_block' ELSE 'reject_document' END END AS action
        FROM b WHERE list_contains(quality_flags, 'merged_cross_page_paragraph')),
    sr AS (SELECT document_id, CASE WHEN bool_or(did IS NULL) THEN 'pending_reviews' WHEN bool_or(action = 'reject_document') THEN 'blocked' ELSE 'completed' END AS run_status,
        'final_' || substr(sha256(coalesce(string_agg(did, '|' ORDER BY did), '')), 1, 12) AS finalization_id FROM st GROUP BY 1)"""
_EFFECTIVE = f"""WITH {_S}, {_R}, v AS (SELECT document_id, CASE WHEN run_status = 'completed' THEN finalization_id ELSE 'base_' || document_id END AS rid, CASE WHEN run_status = 'completed' THEN 'ocr_review' ELSE 'base_run' END AS src,
        CASE WHEN right(document_id, 1) IN ('0', '4', '8') THEN finalization_id WHEN right(document_id, 1) IN ('2', '6', 'a') THEN 'base_' || document_id END AS mb FROM r)
        SELECT document_id, CASE WHEN mb = rid THEN 'manual_' || document_id ELSE rid END AS revision_id, CASE WHEN mb = rid THEN 'manual_revision' ELSE src END AS source FROM v"""

ORACLE_SQL = {
    "latest_decision": f"WITH {_L}, {_LAST} SELECT review_id, decision_id, selected_action, seq FROM la",
    "task_states": f"WITH {_S} SELECT review_id, status, review_stage FROM s",
    "review_progress": f"""WITH {_S} SELECT document_id, count(*) AS tasks, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ocr_requested') AS ocr_requested, count(*) FILTER (status = 'ocr_result_ready') AS ocr_result_ready,
        count(*) FILTER (status = 'decided') AS decided, count(*) FILTER (status = 'applied') AS applied, coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (status = 'applied')), ','), '') AS applied_pages FROM s GROUP BY 1""",
    "review_queue": f"WITH {_S} SELECT review_id, status FROM s WHERE status IN ('pending', 'ocr_requested', 'ocr_result_ready')",
    "decision_errors": f"""WITH {_L.replace("l AS", "l0 AS")}, l AS (SELECT * REPLACE (CASE WHEN seq % 10 = 0 THEN ' ' ELSE reviewer END AS reviewer, CASE WHEN seq % 7 = 0 THEN 'delete' ELSE selected_action END AS selected_action) FROM l0), e AS (SELECT decision_id, unnest([CASE WHEN NOT coalesce(selected_action IN ('run_ocr', 'approve_native', 'approve_ocr', 'merge_results', 'retry_ocr', 'exclude_page', 'reject_document'), false) THEN 'action is not allowed' END,
        CASE WHEN trim(coalesce(reviewer, '')) = '' THEN 'reviewer is required' END, CASE WHEN selected_action = 'merge_results' AND coalesce(len(native_block_ids), 0) = 0 THEN 'merge_results needs block ids' END]) AS error FROM l) SELECT decision_id, error FROM e WHERE error IS NOT NULL""",
    "run_status": f"WITH {_S}, {_R} SELECT document_id, run_status, finalization_id FROM r",
    "new_tasks": f"WITH {_T} SELECT review_id FROM t WHERE page_number <> 1",
    "refused_tasks": f"WITH {_T} SELECT review_id FROM t WHERE page_number IN (1, 2)",
    "applied_blocks": f"""WITH {B}, {_L}, {_LAST}, n AS (SELECT la.review_id, b.block_id, selected_action, native_block_ids FROM b JOIN la ON la.document_id = b.document_id AND la.page_number = b.page_start)
        SELECT review_id, block_id, 'native' AS final_source FROM n WHERE selected_action = 'approve_native' OR selected_action = 'merge_results' AND coalesce(list_contains(native_block_ids, block_id) OR list_contains(native_block_ids, 'all'), false)
        UNION ALL SELECT review_id, block_id || '_ocr', 'ocr' FROM n WHERE selected_action IN ('approve_ocr', 'merge_results')""",
    "finalized_blocks": f"""WITH {B}, {_S}, {_R}, {_FINAL}, ok AS (SELECT document_id FROM fin WHERE run_status = 'completed'),
        o AS (SELECT b.* FROM b JOIN ok USING (document_id)), gone AS (SELECT o.block_id FROM o JOIN pg USING (document_id) WHERE pg.page_number BETWEEN o.page_start AND coalesce(o.page_end, o.page_start) UNION SELECT block_id FROM ti),
        w AS (SELECT document_id, max(review_id) AS review_id FROM pg GROUP BY document_id, page_number UNION SELECT document_id, review_id FROM ti),
        k AS (SELECT document_id, block_id, page_start, bbox, block_order FROM o WHERE block_id NOT IN (SELECT block_id FROM gone)
            UNION ALL SELECT s.document_id, s.review_id || '_new', s.page_number, NULL, 0 FROM s JOIN w USING (document_id, review_id) JOIN ok USING (document_id) WHERE selected_action IN ('approve_ocr', 'merge_results'))
        SELECT block_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page_start, 0), coalesce(bbox[2], 0), coalesce(bbox[1], 0), block_order, block_id)::BIGINT AS block_order FROM k""",
    "run_finalization": f"WITH {B}, {_S}, {_R}, {_FINAL} SELECT document_id, run_status, reason FROM fin",
    "recorded_results": f"WITH {_L}, {_LAST}, {_ANSWERS} SELECT review_id, decision_id AS requested_decision_id, review_id || '_blocks.json' AS ocr_blocks_path FROM la JOIN an USING (review_id) WHERE selected_action IN ('run_ocr', 'retry_ocr') AND there",
    "refused_results": f"WITH {_L}, {_LAST}, {_ANSWERS} SELECT review_id, CASE WHEN selected_action IN ('run_ocr', 'retry_ocr') THEN 'files_missing' ELSE 'no_ocr_requested' END AS reason FROM la JOIN an USING (review_id) WHERE NOT (selected_action IN ('run_ocr', 'retry_ocr') AND there)",
    "bulk_decisions": f"WITH {D} SELECT 'r_' || document_id AS review_id, 'run_ocr' AS selected_action, 'me' AS reviewer FROM d WHERE lang IS NOT NULL AND file_type = 'pdf'",
    "executable_tasks": f"WITH {_S} SELECT review_id FROM s WHERE status = 'ocr_requested'",
    "tasks_by_run": f"""WITH {_S}, f AS (SELECT document_id, min(source_path) AS filename FROM parsed_documents GROUP BY 1)
        SELECT document_id AS run_id, any_value(filename) AS filename, count(*) AS tasks, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages, count(*) FILTER (status = 'applied') AS applied FROM s LEFT JOIN f USING (document_id) GROUP BY 1""",
    "task_violations": f"""WITH {_L}, {_LAST}, v AS (SELECT review_id, unnest([CASE WHEN trim(coalesce(document_id, '')) = '' THEN 'document_id is required' END, CASE WHEN page_number < 1 THEN 'page_number is below 1' END,
        CASE WHEN page_number IS NULL AND coalesce(len(native_block_ids), 0) = 0 THEN 'a page or blocks are required' END, CASE WHEN NOT coalesce(selected_action IN ('run_ocr', 'approve_native', 'exclude_page', 'reject_document'), false) THEN 'suggested_action is not allowed' END]) AS violation FROM la) SELECT review_id, violation FROM v WHERE violation IS NOT NULL""",
    "pair_types": f"""WITH {B}, n AS (SELECT document_id, {_NEW_ID} AS block_id, CASE WHEN heading_level > 2 THEN 'paragraph' ELSE block_type END AS t FROM b)
        SELECT document_id, array_to_string(list_sort(list(DISTINCT coalesce(n.t, o.block_type, ''))), ',') AS block_types FROM b o FULL JOIN n USING (document_id, block_id) GROUP BY 1""",
    "structure_final": f"""WITH {B}, {_STRUCTURE} SELECT document_id, run_status, CASE run_status WHEN 'blocked' THEN 'document_rejected_by_structure_review' END AS reason, finalization_id FROM sr""",
    "structure_final_blocks": f"""WITH {B}, {_STRUCTURE} SELECT b.block_id, CASE WHEN action = 'correct_text' THEN 'corrected ' || text ELSE text END AS text, coalesce(excluded_from_retrieval, false) OR coalesce(action = 'exclude_block', false) AS excluded_from_retrieval
        FROM b JOIN sr USING (document_id) LEFT JOIN (SELECT block_id, action FROM st) x USING (block_id) WHERE run_status = 'completed'""",
    "structure_result": f"""WITH {B}, f AS (SELECT block_id FROM b WHERE list_contains(quality_flags, 'merged_cross_page_paragraph')) SELECT b.block_id, CASE WHEN f.block_id IS NOT NULL AND block_order % 3 = 1 AND text IS NOT NULL THEN 'corrected ' || text ELSE text END AS text,
        coalesce(excluded_from_retrieval, false) OR (f.block_id IS NOT NULL AND block_order % 3 = 2) AS excluded_from_retrieval, array_to_string(CASE WHEN f.block_id IS NOT NULL THEN list_filter(quality_flags, lambda x: x <> 'merged_cross_page_paragraph') ELSE quality_flags END, ',') AS flags FROM b LEFT JOIN f USING (block_id)""",
    "effective_revision": _EFFECTIVE,
    "loaded_revisions": f"SELECT document_id, revision_id, source, CASE WHEN source = 'base_run' THEN 'review is not complete' END AS problem FROM ({_EFFECTIVE})",
    "block_difference": f"""WITH {B}, o AS (SELECT block_id, text, block_order FROM b), n AS (SELECT {_NEW_ID} AS block_id, CASE WHEN block_type = 'heading' THEN text || '!' ELSE text END AS text, block_order FROM b)
        SELECT coalesce(n.block_id, o.block_id) AS block_id, CASE WHEN o.block_id IS NULL THEN 'added' WHEN n.block_id IS NULL THEN 'removed' WHEN o.text IS DISTINCT FROM n.text THEN 'changed' ELSE 'same' END AS change, coalesce(n.block_order, o.block_order)::BIGINT AS rank FROM o FULL JOIN n USING (block_id)""",
    "amended_blocks": f"""WITH {B}, l AS (SELECT document_id, max(block_order) AS last FROM b GROUP BY 1) SELECT block_id, coalesce(excluded_from_retrieval, false) AND block_order % 2 <> 0 AS excluded, block_order::BIGINT AS block_order FROM b
        UNION ALL SELECT document_id || '_manual_0001', false, (last + 1)::BIGINT FROM b JOIN l USING (document_id) WHERE block_order = 1 AND page_start IS NOT NULL""",
    "missing_ids": f"WITH {B}, {_L} SELECT DISTINCT x AS block_id FROM (SELECT unnest(native_block_ids) AS x FROM l) WHERE x NOT IN (SELECT block_id FROM b)",
    "history_search": """WITH f AS (SELECT 'job_' || coalesce(site, 'none') AS job_id, original_filename AS filename, source_id, row_number() OVER (PARTITION BY 'job_' || coalesce(site, 'none') ORDER BY source_id) - 1 AS "index" FROM source_files)
        SELECT job_id, "index"::BIGINT AS "index", filename FROM f WHERE source_id % 3 = 0 AND (contains(lower(filename), 'report') OR contains(lower(job_id), 'report'))""",
}
