"""Columns nobody asked for, under names the operators use themselves, change nothing; nor do rows that come twice."""

import pytest
from pyspark.sql import functions as F

from blockloom.llm import boilerplate, lookalikes, markup, mojibake, repeats, scans, subjects, tokens
from blockloom.llm.queries import VOCABULARY

CLASHES = ["pos", "k1", "k2", "n", "m", "node", "first", "value", "field", "noise", "links", "fix", "titles", "page_site", "own", "score", "line", "line_no", "k", "restored", "ids", "n_tokens", "area", "share", "record_key", "place", "__text", "bucket"]


def with_clashes(df):
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES if c not in df.columns))


@pytest.fixture(scope="module")
def tables(spark, make_blocks):
    rows = []
    for d in range(12):
        rows.append({"document_id": f"d{d}", "block_id": f"a{d}", "site": "s", "block_type": "heading", "text": f"Report {d} on the water, Town {2000 + d}", "heading_level": 1, "block_order": 1, "heading_path": ["ｘ"]})
        rows.append({"document_id": f"d{d}", "block_id": f"b{d}", "site": "s", "block_type": "paragraph", "text": f"Home page menu\nThe pumps of town {chr(97 + d) * 3} were seen. <b>Again</b>\n- {d} -", "block_order": 2, "page_start": 1, "page_end": 1})
    rows += [{"block_id": "nulls"}, {"document_id": "d0", "block_id": "g", "site": "s", "block_type": "paragraph", "text": "caf� x", "block_order": 3}]
    blocks = make_blocks(rows)
    documents = spark.createDataFrame([(f"d{d}", f"Report {d} on the water, Town {2000 + d}", "html", "s", '{"scanned": true}') for d in range(12)], "document_id string, title string, file_type string, site string, metadata string")
    sites = spark.createDataFrame([("s", "Acme")], "site string, org_name string")
    return blocks, documents, sites


QUERIES = {
    "mojibake": lambda b, d, s: mojibake.found(b, d),
    "markup": lambda b, d, s: markup.found(b),
    "scans": lambda b, d, s: scans.found(b, d),
    "repeats": lambda b, d, s: repeats.found(b),
    "lookalikes": lambda b, d, s: lookalikes.found(b, d),
    "boilerplate": lambda b, d, s: boilerplate.found(b, d, s),
}


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(tables, name):
    plain = sorted(map(tuple, QUERIES[name](*tables).collect()))
    more = [with_clashes(t.unionAll(t)) for t in tables]
    assert plain and sorted(map(tuple, QUERIES[name](*more).collect())) == plain


def test_documents(spark):
    docs = spark.createDataFrame([(1, "court verdict clause today.", "s"), (2, "match league trophy today.", "s")] * 2, "doc_id bigint, text string, source string")
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "area string, description string")
    labels = spark.createDataFrame([(1, "law", 1), (2, "sport", 1)], "doc_id bigint, area string, annotator int")
    assert subjects.found(with_clashes(docs), areas, labels).count() >= 0
    assert tokens.encode(with_clashes(docs), VOCABULARY).columns == ["doc_id", "ids"] and tokens.encode(with_clashes(docs), VOCABULARY).count() == 4
