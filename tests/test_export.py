import json

import pytest
from pyspark.sql import functions as F

from blockloom.operators import export, revisions


def rows():
    return [{"document_id": "d", "block_id": f"b{i}", "block_type": t, "text": x, "page_start": p, "page_end": e, "block_order": i, "heading_level": lv, "excluded_from_retrieval": out} for i, (t, x, p, e, lv, out) in enumerate([("heading", "H", 1, 1, 9, None), ("paragraph", "one", 1, 2, None, False), ("list_item", "two", 2, None, None, None), ("paragraph", "hidden", 3, 3, None, True), ("paragraph", "", 3, 3, None, None)])]


def test_markdown_and_json(spark, make_blocks):
    b = make_blocks(rows())
    docs = spark.createDataFrame([("d", "T"), ("empty", None)], "document_id string, title string")
    got = {r.document_id: r.markdown for r in export.document_markdown(b, docs).collect()}
    assert got == {"d": "# T\n\n###### H\n\none\n\n- two\n", "empty": "\n"}
    text = {r.document_id: json.loads(r.json) for r in export.document_json(b.select("document_id", "block_id", "text", "block_order"), docs).collect()}
    assert [x["block_id"] for x in text["d"]["blocks"]] == ["b0", "b1", "b2", "b3", "b4"] and text["empty"]["title"] is None


def test_pages_of_blocks(spark, make_blocks):
    b = make_blocks(rows()).withColumn("pos", F.col("block_order"))
    ids = lambda **k: [r.block_id for r in export.page_of_blocks(b, "d", **k).collect()]
    assert ids(limit=2, offset=1) == ["b1", "b2"] and ids(page=2) == ["b1", "b2"] and ids(block_type="paragraph", page=3) == ["b3", "b4"] and ids(page=9) == []
    with pytest.raises(ValueError):
        export.page_of_blocks(b, "d", limit=101)


def test_difference(spark, make_blocks):
    old = make_blocks(rows()[:3])
    new = make_blocks([r | {"text": "changed"} if r["block_id"] == "b1" else r for r in rows()[1:4]])
    got = {r.block_id: r.change for r in revisions.difference(old, new, ["text"]).collect()}
    assert got == {"b0": "removed", "b1": "changed", "b2": "same", "b3": "added"}
