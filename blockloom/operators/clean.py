"""Cleaning a document's blocks: noise lines, repeated short texts, tables of contents.

All windows are keyed by document_id; call with blocks that are distributed by it, and one exchange serves all of them.
Columns: document_id, pos (order within the document), block_type, text, page_start, quality_flags and any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.text import NOISE_TEXTS, normalize_text

TEXT_TYPES = ("paragraph", "heading", "list_item")
SHORT = 40
_ENTRY = r"\.{4,}\s*\d+\s*$"


def normalized(blocks: DataFrame) -> DataFrame:
    """Texts normalised; null stays null only where a block has no text at all."""
    return blocks.withColumn("text", F.when(F.col("text").isNotNull(), normalize_text("text")))


def without_noise(blocks: DataFrame) -> DataFrame:
    """Without text blocks that are empty or a site's standard words."""
    t = F.coalesce("text", F.lit(""))
    return blocks.where(~(F.col("block_type").isin(*TEXT_TYPES) & ((t == "") | t.isin(*NOISE_TEXTS))))


def without_repeats(blocks: DataFrame) -> DataFrame:
    """Of equal short texts of one document only the first is kept, whatever its type; long texts are all kept."""
    ours = F.col("block_type").isin(*TEXT_TYPES)
    # Long texts get a key of their own position, so that a document full of them isn't one window of equal keys.
    key = F.when(ours & (F.length("text") <= SHORT), F.col("text"))
    rank = F.row_number().over(Window.partitionBy("document_id", "__key", F.when(F.col("__key").isNull(), F.col("pos"))).orderBy("pos"))
    return blocks.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1").drop("__key", "__rank")


def mark_contents(blocks: DataFrame) -> DataFrame:
    """Adds is_contents: all blocks of a page on which at least three and at least half of the texts are lines of a table of contents."""
    page = Window.partitionBy("document_id", "page_start")
    text = F.col("block_type").isin(*TEXT_TYPES) & (F.coalesce("text", F.lit("")) != "")
    entry = text & F.col("text").rlike(_ENTRY)
    n, k = F.sum(F.when(text, 1).otherwise(0)).over(page), F.sum(F.when(entry, 1).otherwise(0)).over(page)
    return blocks.withColumn("is_contents", F.col("page_start").isNotNull() & (k >= 3) & (k / F.greatest(n, F.lit(1)) >= 0.5))


def clean(blocks: DataFrame) -> DataFrame:
    """Normalise, drop noise and repeats, mark tables of contents (flag and exclusion)."""
    out = mark_contents(without_repeats(without_noise(normalized(blocks))))
    flag = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array(F.lit("table_of_contents")))
    new = F.col("is_contents") & ~F.coalesce(F.array_contains("quality_flags", "table_of_contents"), F.lit(False))
    return (
        out.withColumn("quality_flags", F.when(new, flag).otherwise(F.coalesce("quality_flags", F.array().cast("array<string>"))))
        .withColumn("excluded_from_retrieval", F.col("is_contents") | F.coalesce("excluded_from_retrieval", F.lit(False)))
        .drop("is_contents")
    )
