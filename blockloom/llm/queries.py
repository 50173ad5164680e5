"""The pN_ queries of the operators in this subpackage, and SQL where it can express them."""

from __future__ import annotations

import os

from blockloom.llm import boilerplate, lookalikes, markup, mixing, mojibake, repeats, scans, subjects, tokens
from blockloom.tables import table

#: Where the queries of problems 8 and 9 find the vocabulary file of their tokenizer.
VOCABULARY = os.environ.get("BLOCKLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark, sf):
    return mojibake.found(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"))


def p1_restored(spark, sf):
    got = mojibake.restore(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"))
    return got.where("garbled").select("field", "record_key", "restored", "recovered").distinct()


def p2_found(spark, sf):
    return markup.found(table(spark, sf, "blocks"))


def p2_clean(spark, sf):
    return markup.clean(table(spark, sf, "blocks"))


def p3_found(spark, sf):
    return scans.found(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"))


def p3_repaired(spark, sf):
    return scans.repaired(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"))


def p5_found(spark, sf):
    return repeats.found(table(spark, sf, "blocks"))


def p5_texts(spark, sf):
    return repeats.remove(table(spark, sf, "blocks"))


def p6_found(spark, sf):
    return lookalikes.found(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"))


def p6_normalized(spark, sf):
    return lookalikes.normalize(table(spark, sf, "blocks"))


def p7_found(spark, sf):
    return boilerplate.found(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"), table(spark, sf, "sites"))


def p7_body(spark, sf):
    return boilerplate.body(table(spark, sf, "blocks"), table(spark, sf, "parsed_documents"), table(spark, sf, "sites"))


def p8_ids(spark, sf):
    return tokens.encode(table(spark, sf, "documents"), VOCABULARY)


def p9_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), VOCABULARY)[0]


def p9_shares(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), VOCABULARY)[1]


def _subjects(spark, sf):
    return table(spark, sf, "documents"), table(spark, sf, "subject_areas"), table(spark, sf, "subject_labels")


def p10_found(spark, sf):
    return subjects.found(*_subjects(spark, sf))


def p10_composition(spark, sf):
    return subjects.composition(*_subjects(spark, sf))


QUERIES = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
ORACLE_SQL: dict[str, str] = {
    "p5_found": r"""
        WITH lines AS (
            SELECT site, document_id, block_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line
            FROM (SELECT DISTINCT site, document_id, block_id, text FROM blocks
                  WHERE block_type IN ('paragraph', 'list_item') AND site IS NOT NULL AND text IS NOT NULL)
        ), keyed AS (SELECT site, document_id, block_id, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS k FROM lines),
        often AS (SELECT site, k, count(DISTINCT document_id) AS n FROM keyed WHERE length(k) >= 5 GROUP BY site, k),
        sized AS (SELECT site, count(DISTINCT document_id) AS m FROM blocks WHERE site IS NOT NULL GROUP BY site)
        SELECT DISTINCT block_id, line_no FROM keyed JOIN often USING (site, k) JOIN sized USING (site) WHERE n >= 4 AND n >= 0.08 * m
    """,
}
