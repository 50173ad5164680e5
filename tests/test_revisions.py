from pyspark.sql import functions as F

from blockloom.operators import revisions


def test_missing_ids(spark, make_blocks):
    b = make_blocks([{"document_id": "d", "block_id": f"d_{i}", "block_order": i} for i in range(1, 9)])
    ids = spark.createDataFrame([(f"d_{i}",) for i in range(1, 9)] + [("x",)], "block_id string")
    assert [r.block_id for r in revisions.missing(ids, b).collect()] == ["x"]
    assert revisions.missing(ids.where("block_id <> 'x'"), b).count() == 0


def test_difference_of_whole_sides(spark, make_blocks):
    old = make_blocks([{"document_id": "d", "block_id": f"d_{i}", "text": f"t{i}", "page_start": 1, "block_order": i} for i in range(1, 12)])
    assert {r.change for r in revisions.difference(old, old, ["text", "page_start"]).collect()} == {"same"}
    new = old.where("block_id <> 'd_7'").withColumn("text", F.when(F.col("block_id") == "d_5", "new").when(F.col("block_id") == "d_4", F.lit(None)).otherwise(F.col("text")))
    new = new.unionByName(make_blocks([{"document_id": "d", "block_id": "d_12", "text": "t", "page_start": 1, "block_order": 12}]))
    got = {r.block_id: (r.change, r.rank) for r in revisions.difference(old, new, ["text", "page_start"]).collect()}
    assert got == {f"d_{i}": ({4: "changed", 5: "changed", 7: "removed", 12: "added"}.get(i, "same"), i) for i in range(1, 13)}
