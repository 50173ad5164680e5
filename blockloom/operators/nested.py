"""Deeply nested records to related flat tables (problem 4).

A payload is one JSON text whose parts are optional and change shape from sender to sender.  Each Arrow batch of
payloads is decoded once, payload by payload as their shapes differ, into a canonical nested Arrow array (list of blocks,
each with lists of headers, cells, notes, traces, flags and candidates).  From there no row is looked at again: child arrays are emitted from the list
offsets with ``list_flatten`` and ``list_parent_indices``, and the keys of the parents follow by ``take``.

Defined results:

* null, empty or damaged payload (anything that is not one complete JSON text after leading marks and blanks): no rows;
* a JSON value that is not an object: no rows;
* ``blocks`` / ``children`` may be a list, one block, a JSON text of either, an object holding ``items``, or an object
  keyed by block id (the key is then the id); null and missing parts give nothing;
* a block without an id has the id ''; a row given as an object has its cells at the position of the key in the
  headers, or else as written; a null cell is a cell, a null in any other list is nothing but keeps its position;
* repeated input rows give their rows once; other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_SCHEMA = "record_id bigint, parent_id string, block_id string, child string, child_pos int, item_pos int, value string"

_TEXTS = pa.list_(pa.string())
_BLOCK = pa.struct([
    ("block_id", pa.string()), ("parent_id", pa.string()), ("body", pa.string()),
    ("header", _TEXTS), ("cell", pa.list_(pa.list_(pa.struct([("pos", pa.int32()), ("value", pa.string())])))),
    ("note", _TEXTS), ("trace", _TEXTS), ("flag", _TEXTS),
    ("candidate", pa.list_(pa.struct([("value", pa.string()), ("reason", _TEXTS)]))),
])
_OUT = pa.schema([
    ("record_id", pa.int64()), ("parent_id", pa.string()), ("block_id", pa.string()), ("child", pa.string()),
    ("child_pos", pa.int32()), ("item_pos", pa.int32()), ("value", pa.string()),
])
_NESTED = ("children", "table_data", "source_trace", "quality_flags", "metadata")
_LIKE_BLOCK = {"block_id", "block_type", "text", "table_data", "source_trace", "metadata", "children", "quality_flags", "order", "heading_path"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def _opened(value):
    """JSON inside a string counts as the JSON."""
    if isinstance(value, str):
        s = value.strip("﻿ \t\r\n")
        if s[:1] in ("[", "{") and s:
            try:
                return _decode(s)
            except (ValueError, RecursionError):
                return value
    return value


def _listed(value) -> list:
    """A value given alone counts as a list of one; null gives nothing."""
    value = _opened(value)
    if value is None or value == "":
        return []
    return value if isinstance(value, list) else [value]


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _mark(value) -> str | None:
    """Stands for a value where only its being there counts."""
    return None if value is None else ""


def _blocks(value) -> list[tuple[str | None, dict]]:
    value = _opened(value)
    if isinstance(value, dict):
        if "items" in value and isinstance(_opened(value["items"]), list) and not _LIKE_BLOCK & value.keys():
            value = _opened(value["items"])
        elif _LIKE_BLOCK & value.keys():
            value = [value]
        else:
            return [(str(k), v) for k, v in ((k, _opened(v)) for k, v in value.items()) if isinstance(v, dict)]
    if not isinstance(value, list):
        return []
    return [(None, v) for v in map(_opened, value) if isinstance(v, dict)]


def _cells(row, headers: list, text) -> list:
    if isinstance(row, dict):
        at: dict = {}
        for i, h in enumerate(headers):
            at.setdefault(h if isinstance(h, str) else _text(h), i)
        return [{"pos": at.get(k, i), "value": text(v)} for i, (k, v) in enumerate(row.items())]
    return [{"pos": i, "value": text(v)} for i, v in enumerate(row if isinstance(row, list) else [row])]


def _canonical(payload: str | None, text=_text) -> list[dict] | None:
    """The blocks of one payload in the order written, parents before children; values as ``text`` gives them."""
    if payload is None:
        return None
    try:
        doc = _decode(payload.lstrip("﻿ \t\r\n").rstrip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    out: list[dict] = []
    todo = [("", k, b) for k, b in reversed(_blocks(doc.get("blocks")))]
    while todo:
        parent, key, b = todo.pop()
        own = b.get("block_id")
        own = key if own is None else own
        own = "" if own is None else _text(own)
        tab, meta = _opened(b.get("table_data")), _opened(b.get("metadata"))
        tab, meta = tab if isinstance(tab, dict) else {}, meta if isinstance(meta, dict) else {}
        headers, rows = _listed(tab.get("headers")), _opened(tab.get("rows"))
        rows = rows if isinstance(rows, list) else [] if rows is None else [rows]
        if rows and not any(isinstance(r, (list, dict)) for r in map(_opened, rows) if r is not None):
            rows = [rows]
        cand = []
        for c in _listed(meta.get("ocr_candidates")):
            c = _opened(c)
            if c is None:
                cand.append(None)
                continue
            why = _listed(c.get("reason_codes")) if isinstance(c, dict) else []
            cand.append({"value": text(c), "reason": [text(w) for w in why]})
        out.append({
            "block_id": own, "parent_id": parent, "body": text({k: v for k, v in b.items() if k not in _NESTED}),
            "header": [text(h) for h in headers],
            "cell": [None if (r := _opened(row)) is None else _cells(r, headers, text) for row in rows],
            "note": [text(x) for x in _listed(tab.get("notes"))],
            "trace": [text(x) for x in _listed(b.get("source_trace"))],
            "flag": [text(x) for x in _listed(b.get("quality_flags"))],
            "candidate": cand,
        })
        todo += [(own, k, c) for k, c in reversed(_blocks(b.get("children")))]
    return out


def _unnest(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Values of all lists, the index of the parent of each, and the position within the parent."""
    values, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = pc.subtract(pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)), pc.fill_null(pc.list_value_length(lists), 0))
    pos = pc.subtract(pa.array(range(len(values)), pa.int64()), pc.take(start, parent))
    return values, parent, pc.cast(pos, pa.int32())


def _emit(ids: pa.Array, nested: pa.Array) -> Iterator[pa.RecordBatch]:
    blocks, of, _ = _unnest(nested)
    if not len(blocks):
        return
    keys = (pc.take(ids, of), pc.struct_field(blocks, "parent_id"), pc.struct_field(blocks, "block_id"))

    def rows(child: str, at: pa.Array, child_pos, item_pos, value: pa.Array) -> pa.RecordBatch:
        n = len(value)
        full = lambda x: pa.array([x] * n, pa.int32()) if isinstance(x, int) else x
        return pa.RecordBatch.from_arrays([*(pc.take(k, at) for k in keys), pa.array([child] * n, pa.string()), full(child_pos), full(item_pos), value], schema=_OUT)

    yield rows("block", pa.array(range(len(blocks)), pa.int64()), -1, -1, pc.struct_field(blocks, "body"))
    for child in ("header", "note", "trace", "flag"):
        value, at, pos = _unnest(pc.struct_field(blocks, child))
        keep = pc.is_valid(value)
        value, at, pos = (pc.filter(x, keep) for x in (value, at, pos))
        yield rows(child, at, 0, pos, value) if child == "header" else rows(child, at, pos, -1, value)
    row, at, row_pos = _unnest(pc.struct_field(blocks, "cell"))
    cell, in_row, _ = _unnest(row)
    yield rows("cell", pc.take(at, in_row), pc.take(row_pos, in_row), pc.struct_field(cell, "pos"), pc.struct_field(cell, "value"))
    cand, at, pos = _unnest(pc.struct_field(blocks, "candidate"))
    keep = pc.is_valid(cand)
    cand, at, pos = (pc.filter(x, keep) for x in (cand, at, pos))
    yield rows("candidate", at, pos, -1, pc.struct_field(cand, "value"))
    why, in_cand, why_pos = _unnest(pc.struct_field(cand, "reason"))
    keep = pc.is_valid(why)
    why, in_cand, why_pos = (pc.filter(x, keep) for x in (why, in_cand, why_pos))
    yield rows("reason", pc.take(at, in_cand), pc.take(pos, in_cand), why_pos, why)


def _flatten(text):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):  # bounds the nested array, whatever the size of the payloads
                batch = big.slice(start, 500)
                nested = pa.array([_canonical(p, text) for p in batch.column(1).to_pylist()], pa.list_(_BLOCK))
                yield from _emit(batch.column(0), nested)

    return run


def flatten_records(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", values: bool = True) -> DataFrame:
    """One row per item of every nested payload: ``ITEM_SCHEMA``; see the module's text for the defined results.  Without
    values only the places of the items are built."""
    picked = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).cast("string").alias("payload"))
    return picked.mapInArrow(_flatten(_text if values else _mark), ITEM_SCHEMA)


def flat_tables(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """The related tables: blocks and, each with its parent's keys, cells, headers, notes, traces, flags, candidates, reasons."""
    items = flatten_records(records, id_col, payload_col).distinct()
    key = ["record_id", "block_id"]
    of = lambda child: items.where(F.col("child") == child)
    got = lambda f: F.get_json_object("value", f"$.{f}").alias(f)
    return {
        "blocks": of("block").select(*key, "parent_id", got("block_type"), got("text"), got("order").cast("int").alias("order"), F.col("value").alias("body")),
        "headers": of("header").select(*key, F.col("item_pos").alias("column"), "value"),
        "cells": of("cell").select(*key, F.col("child_pos").alias("row"), F.col("item_pos").alias("column"), "value"),
        "notes": of("note").select(*key, F.col("child_pos").alias("pos"), "value"),
        "traces": of("trace").select(*key, F.col("child_pos").alias("pos"), got("parser"), got("raw_object_type"), got("raw_locator"), got("raw_object_index").cast("int").alias("raw_object_index")),
        "flags": of("flag").select(*key, F.col("child_pos").alias("pos"), F.col("value").alias("flag")),
        "candidates": of("candidate").select(*key, F.col("child_pos").alias("pos"), got("candidate_id")),
        "reasons": of("reason").select(*key, F.col("child_pos").alias("candidate_pos"), F.col("item_pos").alias("pos"), F.col("value").alias("reason")),
    }


def found(records: DataFrame) -> DataFrame:
    """The rows of p4_found: one per item, each once."""
    return flatten_records(records, values=False).drop("value").distinct()
