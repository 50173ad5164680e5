import random

from pyspark.sql import functions as F

from blockloom.operators import clean, quality, repair
from blockloom.plans import pipeline


def para(doc, i, text, page, box, **more):
    return {"document_id": doc, "block_id": f"{doc}_{i}", "block_type": "paragraph", "text": text, "page_start": page, "page_end": page, "bbox": box, "page_height": 1000.0, "block_order": i, "quality_flags": []} | more


def test_paragraph_over_a_page_end(spark, make_blocks):
    rows = [para("d", 1, "this sentence continues", 1, [50.0, 800.0, 500.0, 950.0]), para("d", 2, "on the following page", 2, [50.0, 30.0, 500.0, 100.0])]
    out = repair.merge_paragraphs(make_blocks(rows).withColumn("pos", F.col("block_order"))).collect()
    assert [(r.text, r.page_end, r.merged_block_ids, r.quality_flags) for r in out] == [("this sentence continueson the following page", 2, ["d_2"], ["merged_cross_page_paragraph"])]
    rows[0]["text"] = "this sentence ends."
    assert repair.merge_paragraphs(make_blocks(rows).withColumn("pos", F.col("block_order"))).count() == 2


def test_continued_table(spark, make_blocks):
    t = lambda i, rows: {"document_id": "d", "block_id": f"t{i}", "block_type": "table", "table_data": (None, ["name", "value"], rows, []), "page_start": i, "page_end": i, "block_order": i, "quality_flags": []}
    out = repair.merge_tables(make_blocks([t(1, [["a", "1"]]), t(2, [["b", "2"]])]).withColumn("pos", F.col("block_order"))).collect()
    assert len(out) == 1 and out[0].table_data.rows == [["a", "1"], ["b", "2"]] and out[0].page_end == 2 and out[0].is_continued_table


def fold(rows):
    """The heading path as a plain fold."""
    path, out = [], {}
    for r in rows:
        if r.get("excluded_from_retrieval"):
            out[r["block_id"]] = list(path)
        elif r["block_type"] == "heading" and r["text"]:
            path = path[: max((r["heading_level"] if r["heading_level"] is not None else 1) - 1, 0)] + [r["text"]]
            out[r["block_id"]] = list(path)
        else:
            out[r["block_id"]] = r["heading_path"] or list(path)
    return out


def test_heading_paths_against_a_fold(spark, make_blocks):
    random.seed(3)
    rows, want = [], {}
    for d in range(60):
        own = []
        for i in range(random.randint(0, 25)):
            kind = random.choice(["heading", "heading", "paragraph"])
            own.append({"document_id": f"d{d}", "block_id": f"d{d}_{i}", "block_type": kind, "text": random.choice(["", None, f"t{i}", f"t{i}"]), "heading_level": random.choice([None, 0, 1, 2, 3, 6]) if kind == "heading" else None, "excluded_from_retrieval": random.random() < 0.1, "heading_path": random.choice([None, [], ["own"]]), "block_order": i})
        rows += own
        want |= fold(own)
    got = repair.heading_paths(make_blocks(rows).withColumn("pos", F.col("block_order"))).collect()
    assert {r.block_id: r.heading_path for r in got} == want


def test_cleaning(spark, make_blocks):
    text = ["首页", "", None, "short", " short ", "x" * 41, "x" * 41]
    rows = [para("d", i, t, 1, None) for i, t in enumerate(text)] + [para("e", 9, "short", 1, None)]
    out = clean.clean(make_blocks(rows).withColumn("pos", F.col("block_order")))
    assert sorted(r.block_id for r in out.collect()) == ["d_3", "d_5", "d_6", "e_9"]


def test_contents_page(spark, make_blocks):
    rows = [para("d", i, f"chapter {i} ..... {i}", 1, None) for i in range(3)] + [para("d", 3, "text", 1, None), para("d", 4, "text", None, None)]
    out = {r.block_id: r.is_contents for r in clean.mark_contents(make_blocks(rows).withColumn("pos", F.col("block_order"))).collect()}
    assert out == {"d_0": True, "d_1": True, "d_2": True, "d_3": True, "d_4": False}


def test_evaluation_and_empty_tables(spark, make_blocks):
    rows = [para("d", 1, "text", 1, None, quality_flags=["low_confidence", "low_confidence"]), para("e", 1, "text", 1, None)]
    got = {r.document_id: (r.status, r.warning_count) for r in quality.evaluations(pipeline.prepared(make_blocks(rows))).collect()}
    assert got == {"d": ("review_required", 1), "e": ("finalized", 0)}
    none = pipeline.prepared(make_blocks([]))
    assert pipeline.process(none).count() == 0 and quality.evaluations(none).count() == 0 and quality.summaries(none).count() == 0


def test_one_exchange_serves_everything(spark, make_blocks):
    df = pipeline.process(pipeline.prepared(make_blocks([para("d", 1, "t", 1, None)])))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_heading_paths_of_any_depth(spark, make_blocks):
    levels = [*range(1, 31), 25, 17, 18, 5, *range(6, 20), 17]
    rows = [{"document_id": "d", "block_id": f"d_{i}", "block_type": "heading", "text": f"t{i}", "heading_level": x, "heading_path": None, "block_order": i} for i, x in enumerate(levels)]
    rows.append({"document_id": "d", "block_id": "d_p", "block_type": "paragraph", "text": "p", "heading_path": None, "block_order": len(levels)})
    got = {r.block_id: r.heading_path for r in repair.heading_paths(make_blocks(rows).withColumn("pos", F.col("block_order"))).collect()}
    assert got == fold(rows) and len(got["d_29"]) == 30 and len(got["d_p"]) == 17
