import json

from blockloom.operators import nested


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id bigint, payload string, value string")
    return {tuple(r) for r in nested.found(df).collect()}


def test_shapes(spark):
    block = {"block_id": "b", "table_data": {"headers": ["h", "i"], "rows": [["1", None], {"i": "2"}], "notes": "n"}, "source_trace": {"parser": "p"}, "quality_flags": "f", "metadata": json.dumps({"ocr_candidates": {"reason_codes": "R"}}), "children": {"block_id": "c"}}
    got = rows(spark, ["﻿\n" + json.dumps({"blocks": block})])
    key = lambda child, a, b, block="b", parent="": (0, parent, block, child, a, b)
    assert got == {
        key("block", -1, -1), key("block", -1, -1, "c", "b"), key("header", 0, 0), key("header", 0, 1), key("cell", 0, 0), key("cell", 0, 1), key("cell", 1, 1), key("note", 0, -1), key("trace", 0, -1), key("flag", 0, -1), key("candidate", 0, -1), key("reason", 0, 0),
    }


def test_blocks_by_key_and_items_and_text(spark):
    got = rows(spark, [json.dumps({"blocks": {"a": {"block_type": "x"}, "b": {}}}), json.dumps({"blocks": {"items": [{"block_id": "c"}, None]}}), json.dumps({"blocks": json.dumps([{"block_id": "d"}])})])
    assert {(r[0], r[2]) for r in got} == {(0, "a"), (0, "b"), (1, "c"), (2, "d")}


def test_nothing_from_damaged_or_empty(spark):
    assert rows(spark, [None, "", "{", '{"blocks": [1, null, "x"]}', "[1]", '{"blocks": null}', '{"a": NaN}', '{"blocks": []} x']) == set()
    assert rows(spark, []) == set()


def test_repeats_count_once_and_depth(spark):
    deep = {"block_id": "b0"}
    for i in range(1, 60):
        deep = {"block_id": f"b{i}", "children": [deep]}
    text = json.dumps({"blocks": [deep]})
    df = spark.createDataFrame([(1, text), (1, text)], "record_id bigint, payload string")
    assert nested.found(df).count() == 60
    tables = nested.flat_tables(df)
    assert tables["blocks"].count() == 60 and tables["cells"].count() == 0
