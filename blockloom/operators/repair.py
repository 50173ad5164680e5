"""Repairing a document's blocks: reading order, paragraphs and tables cut by page ends, heading paths.

The folds over a document's blocks are written as window functions over (document_id, pos); chained, they share one
exchange.  bbox is [left, top, right, bottom]; an empty one counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEEPEST = 16


def _by():
    return Window.partitionBy("document_id").orderBy("pos")


def _so_far():
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def _box(i: int) -> Column:
    return F.when(F.size("bbox") == 4, F.get("bbox", F.lit(i)))


def reading_order(blocks: DataFrame) -> DataFrame:
    """pos anew: by page (none last), by the top of the box (else the order), by its left edge (else 0), by order, by pos."""
    order = [F.coalesce(F.col("page_start").cast("double"), F.lit(1e9)), F.coalesce(_box(1), F.col("block_order").cast("double")), F.coalesce(_box(0), F.lit(0.0)), F.col("block_order"), F.col("pos")]
    return blocks.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs that run over page ends are one block: text glued, page_end of the last, a flag and the id of each part.

    A part follows the one before if both are paragraphs with text and box, it is on the next page, in its upper quarter,
    longer than ten signs, the one before doesn't end a sentence, and the head of the chain lies in the lower 30 % of its page.
    """
    lag = lambda c: F.lag(c).over(_by())
    t = F.coalesce("text", F.lit(""))
    rows = blocks.withColumn("__has", (F.col("block_type") == "paragraph") & (t != "") & (F.size("bbox") == 4))
    follows = (
        F.col("__has") & lag("__has")
        & (F.col("page_start") == lag("page_end") + 1)
        & (F.col("page_height") > 0) & (_box(1) <= F.col("page_height") * 0.25)
        & ~lag("text").rlike("[。！？.!?；;：:]$") & (F.length(t) > 10)
    )
    low = (F.lag("page_height").over(_by()) > 0) & (F.lag(_box(3)).over(_by()) >= F.lag("page_height").over(_by()) * 0.70)
    rows = rows.withColumn("__c", F.coalesce(follows, F.lit(False))).withColumn("__low", F.coalesce(low, F.lit(False)))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__c"), 0).otherwise(1)).over(_so_far()))
    chain = Window.partitionBy("document_id", "__island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    link = F.col("__c") & F.coalesce(F.max(F.when(F.col("__c"), F.col("__low"))).over(chain), F.lit(False))
    rows = rows.withColumn("__link", link).withColumn("__group", F.sum(F.when(F.col("__link"), 0).otherwise(1)).over(_so_far()))
    whole = Window.partitionBy("document_id", "__group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = F.collect_list(F.struct("pos", "text", "block_id")).over(whole)
    rows = rows.withColumn("__parts", F.array_sort(parts)).withColumn("__last", F.last("page_end").over(whole))
    edge = lambda x, i, n: F.regexp_replace(F.when(i > 0, F.regexp_replace(x, r"(?U)\A[\s\x1c-\x1f]+", "")).otherwise(x), r"(?U)[\s\x1c-\x1f]+\z", "")
    n = F.size("__parts")
    glued = F.array_join(F.transform("__parts", lambda p, i: edge(p["text"], i, n)), "")
    more = n > 1
    flags = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array_repeat(F.lit("merged_cross_page_paragraph"), n - 1))
    rows = rows.where(~F.col("__link"))
    rows = rows.withColumn("merged_block_ids", F.when(more, F.transform(F.slice("__parts", F.lit(2), F.greatest(n - 1, F.lit(1))), lambda p: p["block_id"])).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("text", F.when(more, glued).otherwise(F.col("text"))).withColumn("page_end", F.when(more, F.col("__last")).otherwise(F.col("page_end"))).withColumn("quality_flags", F.when(more, flags).otherwise(F.coalesce("quality_flags", F.array().cast("array<string>"))))
    return rows.drop("__has", "__c", "__low", "__island", "__link", "__group", "__parts", "__last")


def merge_tables(blocks: DataFrame) -> DataFrame:
    """A table that goes on on the next page under the same headers is one block: rows one after the other."""
    heads = F.col("table_data.headers")
    same = (
        (F.col("block_type") == "table") & (F.lag("block_type").over(_by()) == "table") & (F.col("page_start") == F.lag("page_end").over(_by()) + 1)
        & (F.size(heads) > 0) & (heads == F.lag(heads).over(_by()))
    )
    rows = blocks.withColumn("__link", F.coalesce(same, F.lit(False))).withColumn("__group", F.sum(F.when(F.col("__link"), 0).otherwise(1)).over(_so_far()))
    whole = Window.partitionBy("document_id", "__group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_table = F.col("block_type") == "table"
    part = F.struct("pos", F.coalesce(F.col("table_data.rows"), F.array().cast("array<array<string>>")).alias("rows"), "block_id")
    rows = rows.withColumn("__parts", F.array_sort(F.collect_list(F.when(is_table, part)).over(whole))).withColumn("__last", F.last("page_end").over(whole))
    more = is_table & (F.size("__parts") > 1)
    rows = rows.where(~F.col("__link"))
    rows = rows.withColumn("table_data", F.when(more, F.col("table_data").withField("rows", F.flatten(F.transform("__parts", lambda p: p["rows"])))).otherwise(F.col("table_data")))
    flags = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array_repeat(F.lit("merged_continued_table"), F.size("__parts") - 1))
    rows = rows.withColumn("is_continued_table", more).withColumn("page_end", F.when(more, F.col("__last")).otherwise(F.col("page_end"))).withColumn("quality_flags", F.when(more, flags).otherwise(F.col("quality_flags")))
    return rows.drop("__link", "__group", "__parts", "__last")


def heading_paths(blocks: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """heading_path: of headings the open headings above and themselves, of others the open headings unless they have a path.

    A heading of level l keeps the first l - 1 open ones (by position, not by level) and adds itself; excluded blocks get the
    open path and open nothing.  The depth after the k-th heading is k + min(0, min over j <= k of (l_j - j)), so a running
    minimum gives it, and the heading at each depth is the last one that had it.  Each of the first ``deepest`` steps is a
    window function; deeper steps are looked up in the list of the document's deeper headings so far, which is empty where
    none nest so deep.
    """
    pushes = (F.col("block_type") == "heading") & (F.coalesce("text", F.lit("")) != "") & ~F.coalesce("excluded_from_retrieval", F.lit(False))
    rows = blocks.withColumn("__push", F.coalesce(pushes, F.lit(False))).withColumn("__k", F.sum(F.when(F.col("__push"), 1).otherwise(0)).over(_so_far()))
    keeps = F.greatest(F.coalesce("heading_level", F.lit(1)) - 1, F.lit(0))
    least = F.min(F.when(F.col("__push"), keeps + 1 - F.col("__k"))).over(_so_far())
    rows = rows.withColumn("__depth", F.col("__k") + F.least(F.lit(0), F.coalesce(least, F.lit(0)))).withColumn("__depth", F.when(F.col("__push"), F.col("__depth")))
    rows = rows.withColumn("__open", F.coalesce(F.last("__depth", ignorenulls=True).over(_so_far()), F.lit(0)))
    steps = [F.last(F.when(F.col("__push") & (F.col("__depth") == d), F.col("text")), ignorenulls=True).over(_so_far()) for d in range(1, deepest + 1)]
    rows = rows.withColumn("__steps", F.array(*steps))
    deeper = F.when(F.col("__push") & (F.col("__depth") > deepest), F.struct(F.col("__depth").alias("d"), "text"))
    rows = rows.withColumn("__deeper", F.collect_list(deeper).over(_so_far()))
    last = lambda d: F.element_at(F.filter("__deeper", lambda h: h.d == d), -1).text
    tail = F.transform(F.sequence(F.lit(deepest + 1).cast("bigint"), F.col("__open").cast("bigint")), last)
    path = F.when(F.col("__open") > 0, F.slice("__steps", F.lit(1), F.greatest("__open", F.lit(1)).cast("int"))).otherwise(F.array().cast("array<string>"))
    path = F.when(F.col("__open") > deepest, F.concat("__steps", tail)).otherwise(path)
    own = F.coalesce(F.size("heading_path") > 0, F.lit(False)) & ~F.col("__push") & ~F.coalesce("excluded_from_retrieval", F.lit(False))
    return rows.withColumn("heading_path", F.when(own, F.col("heading_path")).otherwise(path)).drop("__push", "__k", "__depth", "__open", "__steps", "__deeper")


def repair(blocks: DataFrame) -> DataFrame:
    """Reading order, paragraphs, tables, heading paths; pos is counted anew."""
    out = heading_paths(merge_tables(merge_paragraphs(reading_order(blocks))))
    return out.withColumn("pos", F.row_number().over(_by()))
