import json
import os

from pyspark.sql import functions as F

from blockloom.operators import review, revisions, runs, validate
from blockloom.sources import assets, records

GOOD = {"document_id": "d", "title": "t", "file_type": "md", "source_path": "/x", "metadata": json.dumps({"schema_version": "1.0"}), "parsed_at": "2024-01-01T00:00:00+00:00", "blocks": [{"block_id": "b", "document_id": "d", "block_type": "paragraph", "text": "x", "bbox": [0, 0, 1, 1], "page_start": 1, "block_order": 0}]}


def violations(spark, **change):
    doc = GOOD | change
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    return {r.violation for r in records.strict(records.documents_of(df)).collect()}


def test_contract(spark):
    b = GOOD["blocks"][0]
    assert violations(spark) == set()
    assert violations(spark, metadata=json.dumps({"schema_version": "2.0"})) == {"schema_version differs"}
    assert violations(spark, blocks=[b | {"document_id": "e"}]) == {"a block names another document"}
    assert violations(spark, blocks=[b | {"bbox": [0, 1]}]) == {"bbox needs four numbers"}
    assert violations(spark, blocks=[b, b]) == {"block_id comes twice"}
    assert violations(spark, title=" ", blocks=[b | {"page_start": 0, "page_end": 5}]) == {"title is required", "page_start is below 1"}
    bad = records.documents_of(spark.createDataFrame([("{",), (None,), ("[]",)], "json string"))
    assert records.strict(bad).collect()[0].violation == "no document"


def test_block_lists_and_settings(spark, tmp_path):
    df = spark.createDataFrame([('{"blocks": [{"block_id": "a"}]}',), ('[{"block_id": "b"}, null]',), ("x",), (None,)], "t string")
    assert [[b.block_id for b in r.x] for r in df.select(records.block_list("t").alias("x")).collect()] == [["a"], ["b"], [], []]
    (tmp_path / "env").write_text("# no\nBLOCKLOOM_TEST_A = 'x'\nPATH=never\nplain\n")
    path = os.environ["PATH"]
    records.settings(str(tmp_path / "env"))
    assert os.environ.pop("BLOCKLOOM_TEST_A") == "x" and os.environ["PATH"] == path


def test_task_states_by_order_not_clock(spark):
    tasks = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "review_id string")
    log = spark.createDataFrame([(1, "d1", "r1", "approve_native"), (2, "d2", "r1", "run_ocr"), (3, "d3", "r2", "retry_ocr"), (4, "d4", "r3", "exclude_page")], "seq bigint, decision_id string, review_id string, selected_action string")
    results = spark.createDataFrame([("r1", 1, "d2"), ("r2", 1, "old")], "review_id string, seq bigint, requested_decision_id string")
    applied = spark.createDataFrame([("r3", "d4")], "review_id string, decision_id string")
    got = {r.review_id: (r.status, r.review_stage) for r in review.task_states(tasks, log, results, applied).collect()}
    assert got == {"r1": ("ocr_result_ready", "post_ocr"), "r2": ("ocr_requested", "post_ocr"), "r3": ("applied", "pre_ocr"), "r4": ("pending", "pre_ocr")}


def test_effective_revision(spark):
    rows = [("d", "base_run", "b", None, "completed", 1), ("d", "ocr_review", "o", "b", "completed", 2), ("d", "manual_revision", "m", "o", "completed", 3), ("e", "base_run", "b", None, "completed", 1), ("e", "structure_review", "s", "b", "blocked", 2), ("f", "base_run", "b", None, "completed", 1), ("f", "manual_revision", "m", "b", "completed", 2), ("f", "ocr_review", "o", "b", "completed", 3)]
    df = spark.createDataFrame(rows, "document_id string, source string, revision_id string, base_revision_id string, status string, seq int")
    assert {(r.document_id, r.revision_id) for r in revisions.effective(df).collect()} == {("d", "m"), ("e", "b"), ("f", "o")}


def test_gate_and_assets(spark):
    gate = spark.createDataFrame([("base_run", "finalized", 0, ["resolved"]), ("base_run", "review_required", 0, []), ("ocr_review", "review_required", 0, None), ("ocr_review", "finalized", 0, ["pending"]), ("ocr_review", "blocked", 0, []), ("ocr_review", "finalized", None, [])], "source string, status string, error_count int, item_statuses array<string>")
    assert [r.passes for r in validate.review_gate(gate).collect()] == [True, False, True, False, False, False]
    pics = spark.createDataFrame([("html", "data:image/png;base64,eA=="), ("html", "https://x/y.png"), ("markdown", "../up.png"), ("markdown", "img/a.png"), ("pdf", "a"), ("html", None)], "file_type string, image_path string")
    rows = pics.select("file_type", F.struct("image_path").alias("image"), F.lit(None).cast("string").alias("raw_locator"), F.lit("b").alias("block_id"))
    assert [r.s.reason_code or r.s.status for r in rows.select(assets.asset_state().alias("s")).collect()] == ["inline", "REMOTE_IMAGE_REQUIRES_FETCH_POLICY", "IMAGE_PATH_OUTSIDE_SOURCE_ROOT", "local", "UNSUPPORTED_IMAGE_SOURCE", "IMAGE_REFERENCE_MISSING"]
    assert assets.inline_bytes(rows).collect()[0].content == b"x"


def test_runs(spark):
    f = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, document_id string")
    assert [r.path for r in runs.unfinished(f, f.where("path = 'a'")).collect()] == ["b"]
    t = spark.createDataFrame([(["<h>"], [[None, "b'"]])], "headers array<string>, rows array<array<string>>").select(F.struct("headers", "rows").alias("t"))
    assert t.select(runs.table_preview("t")).collect()[0][0] == "<table><tr><td>&lt;h&gt;</td></tr><tr><td></td><td>b&#x27;</td></tr></table>"
