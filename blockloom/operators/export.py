"""Documents as Markdown and JSON, pages of blocks, and history lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import main_text


def block_markdown() -> Column:
    """The Markdown of one block: heading of level 2 to 6, list item, picture, or text."""
    t = main_text("block_type", "text", "table_data", "image")
    level = F.greatest(F.least(F.when(F.coalesce("heading_level", F.lit(0)) == 0, 2).otherwise(F.col("heading_level")), F.lit(6)), F.lit(2))
    return (
        F.when(t == "", "").when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t))
        .when(F.col("block_type") == "list_item", F.concat(F.lit("- "), t)).when(F.col("block_type") == "image", F.concat(F.lit("[图片："), t, F.lit("]"))).otherwise(t)
    )


def document_markdown(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, markdown): title, then the blocks that aren't excluded and have text, by order and page."""
    rows = blocks.where(~F.coalesce("excluded_from_retrieval", F.lit(False))).withColumn("md", block_markdown()).where("md <> ''")
    body = rows.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", F.coalesce("page_start", F.lit(0)).alias("p"), "block_id", "md"))), lambda s: s["md"]), "\n\n").alias("body"))
    out = documents.select("document_id", F.coalesce("title", F.lit("")).alias("title")).join(body, "document_id", "left")
    whole = F.concat_ws("\n\n", F.when(F.col("title") != "", F.concat(F.lit("# "), "title")), "body")
    return out.select("document_id", F.concat(F.regexp_replace(whole, r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit("\n")).alias("markdown"))


def document_json(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, json): the document with its blocks in order, null fields kept."""
    fields = F.struct(F.col("block_order"), F.struct(*[c for c in blocks.columns if c not in ("document_id",)]).alias("block"))
    parts = blocks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(fields), lambda a, b: F.when(a["block_order"] < b["block_order"], -1).when(a["block_order"] > b["block_order"], 1).otherwise(0)), lambda s: s["block"]).alias("blocks"))
    return documents.join(parts, "document_id", "left").select("document_id", F.to_json(F.struct(*[c for c in documents.columns], "blocks"), {"ignoreNullFields": "false"}).alias("json"))


def page_of_blocks(blocks: DataFrame, document_id: str, offset: int = 0, limit: int = 50, block_type: str | None = None, page: int | None = None) -> DataFrame:
    """A page of a document's blocks in order: at most 100, of a type, on a page."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100, offset 0 or more")
    rows = blocks.where(F.col("document_id") == document_id)
    if block_type:
        rows = rows.where(F.col("block_type") == block_type)
    if page is not None:
        rows = rows.where((F.col("page_start") <= page) & (F.coalesce("page_end", "page_start") >= page))
    return rows.orderBy("pos" if "pos" in blocks.columns else "block_order").offset(offset).limit(limit)


def search_history(jobs: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Files of jobs whose name or job contains a text, whatever its case, in a state, newest job first."""
    rows = jobs.select("job_id", "created_at", F.posexplode("files").alias("index", "file")).select("job_id", "created_at", "index", "file.*")
    low = text.lower()
    rows = rows.where(F.lower("filename").contains(low) | F.lower("job_id").contains(low))
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id", "index")
