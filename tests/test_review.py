from pyspark.sql import functions as F

from blockloom.operators import quality, review, revisions, runs, tasks, validate
from blockloom.plans import pipeline

STATES = "review_id string, document_id string, page_number int, target_block_ids array<string>, selected_action string, status string, decision_id string"


def document(make_blocks, doc, pages):
    return make_blocks([{"document_id": doc, "block_id": f"{doc}_{i}", "block_type": "paragraph", "text": f"Text number {i}.", "page_start": a, "page_end": b, "block_order": i} for i, (a, b) in enumerate(pages, 1)])


def test_finalize(spark, make_blocks):
    b = document(make_blocks, "d", [(1, 1), (2, 2), (3, 3)])
    for name in ("cut", "gone", "twice", "open", "no", "none"):
        b = b.unionByName(document(make_blocks, name, [(1, 1), (2, 4), (5, 5)]))
    rows = [
        ("r1", "d", None, ["d_2"], "approve_ocr", "applied", "x1"), ("r2", "d", 3, [], "merge_results", "applied", "x2"), ("r3", "d", 1, None, "approve_native", "applied", "x3"),
        ("c1", "cut", 3, None, "exclude_page", "applied", "x4"), ("g1", "gone", None, ["gone_9"], "approve_ocr", "applied", "x5"), ("t1", "twice", None, ["twice_1"], "approve_ocr", "applied", "x6"), ("t2", "twice", None, ["twice_1"], "approve_ocr", "applied", "x7"),
        ("o1", "open", 1, None, "approve_native", "decided", "x8"), ("n1", "no", 1, None, "reject_document", "applied", "x9"), ("m1", "none", None, None, "exclude_page", "applied", "y1"),
    ]
    states = spark.createDataFrame(rows, STATES)
    got = {r.document_id: (r.run_status, r.reason) for r in review.finalization(b, states).collect()}
    assert got == {
        "d": ("completed", None), "cut": ("blocked", "reviewed_page_intersects_cross_page_block"), "gone": ("error", "target_blocks_missing"), "twice": ("error", "target_blocks_replaced_twice"),
        "open": ("pending_reviews", None), "no": ("blocked", "document_rejected_by_review"), "none": ("error", "no_page_and_no_target"),
    }
    new = make_blocks([{"document_id": "d", "block_id": k, "block_type": "paragraph", "text": t, "page_start": p, "page_end": p, "block_order": 1} for k, t, p in (("n1", "New two.", 2), ("n2", "New three.", 3))]).withColumn("review_id", F.when(F.col("block_id") == "n1", "r1").otherwise("r2"))
    final = review.finalize(b, states, new).orderBy("block_order").collect()
    assert [(r.block_id, r.block_order) for r in final] == [("d_1", 1), ("n1", 2), ("n2", 3)]
    ran, blocks, judged = pipeline.finalize(b, states, new)
    assert [r.text for r in blocks.orderBy("pos").collect()] == ["Text number 1.", "New two.", "New three."] and [(r.document_id, r.status) for r in judged.collect()] == [("d", "finalized")]
    assert review.finalize(b.limit(0), states.limit(0), new.limit(0)).count() == 0


def test_structure_finalisation(spark, make_blocks):
    b = document(make_blocks, "d", [(1, 1), (2, 2)]).unionByName(document(make_blocks, "e", [(1, 1)]))
    t = spark.createDataFrame([("s1", "d", "d_1", "cross_page_paragraph"), ("s2", "d", "d_2", "cross_page_paragraph"), ("s3", "e", "e_1", "continued_table"), ("s4", "f", "f_1", "continued_table")], "review_id string, document_id string, object_id string, review_type string")
    d = spark.createDataFrame([("s1", "a", 1, "correct_text", "Right."), ("s2", "b", 2, "exclude_block", ""), ("s4", "c", 3, "approve", "")], "review_id string, decision_id string, seq int, selected_action string, corrected_text string")
    assert {r.document_id: (r.run_status, r.reason) for r in review.structure_finalization(b, t, d).collect()} == {"d": ("completed", None), "e": ("pending_reviews", None), "f": ("error", "reviewed_block_not_found")}
    assert {(r.block_id, r.text, r.excluded_from_retrieval) for r in review.finalize_structure(b, t, d).collect()} == {("d_1", "Right.", False), ("d_2", "Text number 2.", True)}
    rejected = d.unionByName(spark.createDataFrame([("s1", "z", 9, "reject_document", "")], d.schema))
    assert review.structure_finalization(b, t, rejected).where("document_id = 'd'").collect()[0].run_status == "blocked"


def test_results_and_allowed_actions(spark):
    d = spark.createDataFrame([("r", "a", 1, "run_ocr"), ("r", "b", 2, "retry_ocr"), ("q", "c", 1, "approve_native"), ("p", "e", 1, "run_ocr")], "review_id string, decision_id string, seq int, selected_action string")
    a = spark.createDataFrame([("r", "p", "x", "y", True), ("q", "p", "x", "y", True), ("p", "p", "x", "y", False), ("none", "p", "x", "y", True)], "review_id string, provider string, provider_result_path string, ocr_blocks_path string, paths_exist boolean")
    ok, refused = review.record_results(d, a)
    assert [(r.review_id, r.requested_decision_id) for r in ok.collect()] == [("r", "b")]
    assert {tuple(r) for r in refused.collect()} == {("q", "no_ocr_requested"), ("p", "files_missing"), ("none", "no_ocr_requested")}
    task = spark.createDataFrame([("r", "d", 1, ["run_ocr"])], "review_id string, document_id string, page_number int, allowed_actions array<string>")
    state = review.task_states(task, d, ok.withColumn("seq", F.lit(1))).collect()[0]
    assert state.status == "ocr_result_ready" and "retry_ocr" in state.allowed_actions
    bad = spark.createDataFrame([("approve_ocr", "　\n", ["run_ocr"])], "selected_action string, reviewer string, allowed_actions array<string>")
    assert review.decision_errors(bad).collect()[0].errors == ["action is not allowed", "reviewer is required"]


def test_documents_without_blocks_are_judged(spark, make_blocks):
    b = document(make_blocks, "d", [(1, 1)]).withColumn("pos", F.col("block_order"))
    docs = spark.createDataFrame([("d",), ("empty",)], "document_id string")
    assert {(r.document_id, r.status, r.block_count) for r in quality.evaluations(b, documents=docs).collect()} == {("d", "finalized", 1), ("empty", "finalized", 0)}
    failed = spark.createDataFrame([("empty", "error", "x", None, None, 0, 0, 0)], "document_id string, level string, warning_type string, page_number int, block_id string, phase int, pos int, k int")
    assert {r.document_id: r.status for r in quality.evaluations(b, failed, documents=docs).collect()} == {"d": "finalized", "empty": "failed"}
    assert {r.document_id: r.block_count for r in quality.summaries(b, documents=docs).collect()} == {"d": 1, "empty": 0}


def test_jobs(spark):
    log = [("a", 1, "submitted"), ("b", 2, "submitted"), ("b", 3, "started"), ("c", 4, "submitted"), ("c", 5, "started"), ("c", 6, "cancel_asked"), ("d", 1, "submitted"), ("d", 2, "started"), ("d", 3, "finished"), ("d", 9, "restarted"), ("e", 1, "submitted"), ("e", 2, "started"), ("e", 9, "restarted"), ("f", 1, "submitted"), ("f", 2, "cancel_asked")]
    got = {r.job_id: r.status for r in runs.job_states(spark.createDataFrame(log, "job_id string, seq int, event string")).collect()}
    assert got == {"a": "queued", "b": "running", "c": "stopping", "d": "completed", "e": "interrupted", "f": "cancelled"}
    files = spark.createDataFrame([("j", "x", "failed"), ("j", "y", "finalized"), ("k", "z", "running"), ("k", "w", "queued")], "job_id string, path string, status string")
    assert [tuple(r) for r in runs.retry(files, "j", "j2").collect()] == [("j2", "x", "queued")]
    assert sorted((r.job_id, r.type, r.path or "") for r in runs.events(files).collect()) == [
        ("j", "batch_finished", ""), ("j", "batch_started", ""), ("j", "file_completed", "x"), ("j", "file_completed", "y"), ("j", "file_started", "x"), ("j", "file_started", "y"), ("k", "batch_started", ""), ("k", "file_started", "z"),
    ]
    states = spark.createDataFrame([("r", "d", "/Out/RUN1"), ("q", "e", None)], "review_id string, document_id string, run_dir string")
    ran = spark.createDataFrame([("job_1", "/out/run1", "a.pdf")], "job_id string, run_dir string, filename string")
    assert {(r.review_id, r.web_job_id, r.source_filename) for r in runs.with_jobs(states, ran).collect()} == {("r", "job_1", "a.pdf"), ("q", "", "e")}


def test_effective_loading_and_reports(spark):
    revs = spark.createDataFrame([("d", "base_run", "b1", None, "completed", 1), ("d", "ocr_review", "o1", "b1", "completed", 2), ("e", "base_run", "b2", None, "completed", 1), ("f", "base_run", "b3", None, "completed", 1)], "document_id string, source string, revision_id string, base_revision_id string, status string, seq int")
    docs = spark.createDataFrame([("o1", "d"), ("b2", "e"), ("b3", "f")], "revision_id string, document_id string")
    judged = spark.createDataFrame([("o1", "d", "finalized", 0, ["applied"]), ("b2", "x", "finalized", 0, []), ("b3", "f", "review_required", 0, [])], "revision_id string, document_id string, status string, error_count int, item_statuses array<string>")
    got = {r.document_id: (r.revision_id, r.problem) for r in revisions.load_effective(revs, docs, judged).collect()}
    assert got == {"d": ("o1", None), "e": ("b2", "evaluation names another document"), "f": ("b3", "review is not complete")}
    assert {r.document_id: r.problem for r in revisions.load_effective(revs, docs, judged, require_complete=False).collect()}["f"] is None
    reports = spark.createDataFrame([("d", "d", [("warning", "t", " ", 0, None)]), ("e", "f", []), ("g", "g", None)], "document_id string, report_document_id string, warnings array<struct<level:string,warning_type:string,message:string,page_number:int,block_id:string>>")
    assert {tuple(r) for r in validate.report_violations(reports).collect()} == {("d", "message is required"), ("d", "page_number is below 1"), ("e", "report names another document"), ("g", "warnings are required")}


def test_render(spark):
    def renderer():
        def run(path, page, dpi):
            if page == 2:
                raise ValueError(path)
            return f"{path}.{page}.{dpi}.png"

        return run

    c = spark.createDataFrame([("a", "x.pdf", 1), ("b", "x.pdf", 2)], "candidate_id string, source_path string, page_number int")
    assert {tuple(r) for r in tasks.render(c, renderer).collect()} == {("a", "x.pdf.1.144.png", None), ("b", None, "ValueError")}
