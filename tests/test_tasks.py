from pyspark.sql import functions as F

from blockloom import cli
from blockloom.operators import tasks
from blockloom.sources import sinks


def candidates(spark):
    rows = [("a", "d", 1, "auto_ocr", ["SCANNED_PAGE"], [], "p1"), ("b", "d", 2, "review_before_ocr", ["MIXED"], ["d_2"], "bad"), ("c", "d", 3, "auto_ocr", [], [], None)]
    return spark.createDataFrame(rows, "candidate_id string, document_id string, page_number int, decision string, reason_codes array<string>, target_block_ids array<string>, preview_path string")


def test_tasks(spark):
    def provider():
        def run(path):
            if path == "bad":
                raise RuntimeError(path)
            return '{"pages": []}'

        return run

    c = candidates(spark)
    results = tasks.execute(c, provider).cache()
    assert {(r.candidate_id, r.result, r.error_type) for r in results.collect()} == {("a", '{"pages": []}', None), ("b", None, "RuntimeError"), ("c", None, "OCR_ASSET_NOT_AVAILABLE")}
    got = {r.candidate_id: r for r in tasks.create(c, "run", results).collect()}
    assert (got["a"].review_stage, got["a"].suggested_action) == ("post_ocr", "approve_ocr") and "retry_ocr" in got["a"].allowed_actions
    assert got["b"].reason_codes == ["MIXED", "OCR_EXECUTION_FAILED"] and got["b"].suggested_action == "approve_native"
    assert got["c"].reason_codes == ["OCR_ASSET_NOT_AVAILABLE"] and got["c"].suggested_action == "run_ocr"
    assert tasks.report(tasks.create(c, "run"), results).collect()[0].asDict() == {"candidate_count": 3, "review_task_count": 3, "executed_count": 1, "failure_count": 2}
    states = tasks.create(c, "run").withColumn("status", F.when(F.col("candidate_id") == "a", "decided").otherwise("pending"))
    assert tasks.bulk(states, "me").count() == 2
    assert tasks.by_run(states, spark.createDataFrame([("d", "f.pdf")], "document_id string, filename string")).collect()[0].pages == [1, 2, 3]
    assert tasks.execute(c.limit(0), provider).count() == 0


def test_rebuild(spark, make_blocks):
    b = make_blocks([{"document_id": "d", "block_id": f"d_{i}", "block_type": "paragraph", "text": "t", "page_start": s, "page_end": e, "block_order": i} for i, (s, e) in enumerate([(1, 1), (1, 3), (3, 3)])])
    t = spark.createDataFrame([("r1", "d", 2, None), ("r2", "d", None, ["d_0"]), ("r3", "d", None, ["x"]), ("r4", "d", 3, [])], "review_id string, document_id string, page_number int, target_block_ids array<string>")
    kept, stopped = tasks.rebuild(b, t, b.limit(0).withColumn("review_id", F.lit("r")))
    assert {tuple(r) for r in stopped.collect()} == {("r1", "target_page_is_inside_cross_page_block"), ("r3", "target_blocks_not_found")}
    assert {(r.review_id, r.block_id) for r in kept.collect()} == {("r2", "d_1"), ("r2", "d_2"), ("r4", "d_0")}


def test_command_line_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nwords of it\n")
    assert cli.main(["parse", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "markdown")).collect()[0].markdown == "# T\n\n## T\n\nwords of it\n"
    df = spark.createDataFrame([("r", "中")], "review_id string, note string")
    sinks.write_queue(df, str(tmp_path / "q.csv"), ["review_id", "note"])
    assert (tmp_path / "q.csv").read_bytes().startswith(b"\xef\xbb\xbfreview_id,note")
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
