"""Which revision of a document holds, amendments, and differences between revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.validate import review_gate

#: Fixed values, strongest first.
SOURCES = ("manual_revision", "structure_review", "ocr_review", "base_run")


def effective(revisions: DataFrame) -> DataFrame:
    """One row a document: the strongest completed revision; a manual one only while what it was based on still holds.

    revisions: document_id, source, revision_id, base_revision_id, status, seq."""
    done = revisions.where((F.col("status") == "completed") | (F.col("source") == "base_run"))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    order = lambda c: Window.partitionBy("document_id").orderBy(c, F.desc("seq"))
    review = done.where("source <> 'manual_revision'").withColumn("n", F.row_number().over(order(rank))).where("n = 1").select("document_id", F.col("revision_id").alias("review_id"), F.col("source").alias("review_source"))
    manual = done.where("source = 'manual_revision'").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("seq")))).where("n = 1").select("document_id", F.col("revision_id").alias("manual_id"), "base_revision_id")
    rows = review.join(manual, "document_id", "left")
    holds = F.coalesce(F.col("base_revision_id") == F.col("review_id"), F.lit(False))
    return rows.select("document_id", F.when(holds, F.col("manual_id")).otherwise(F.col("review_id")).alias("revision_id"), F.when(holds, "manual_revision").otherwise(F.col("review_source")).alias("source"))


def amend(blocks: DataFrame, include: DataFrame, additions: DataFrame) -> DataFrame:
    """Blocks named for inclusion are no longer excluded; paragraphs are added after the last.

    include: document_id, block_id; additions: document_id, seq, page, text."""
    named = include.select("document_id", "block_id").distinct().withColumn("__in", F.lit(True))
    kept = blocks.join(named, ["document_id", "block_id"], "left")
    flags = F.when(F.col("__in"), F.filter("quality_flags", lambda f: f != "excluded_layout_noise")).otherwise(F.col("quality_flags"))
    kept = kept.withColumn("quality_flags", flags).withColumn("excluded_from_retrieval", F.when(F.col("__in"), False).otherwise(F.col("excluded_from_retrieval"))).drop("__in")
    last = blocks.groupBy("document_id").agg(F.max("block_order").alias("last"))
    k = F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))
    new = additions.where("page >= 1 and trim(text) <> ''").join(last, "document_id").withColumn("k", k)
    new = new.select("document_id", F.format_string("%s_manual_%04d", "document_id", "k").alias("block_id"), F.lit("paragraph").alias("block_type"), "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"), (F.col("last") + F.col("k")).alias("block_order"))
    return kept.unionByName(new, allowMissingColumns=True)


def difference(base: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """(block_id, change, rank): every block of either side; changed means any compared column differs."""
    pack = lambda df, name: df.select("block_id", F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}).alias(name), F.col("block_order").alias(f"{name}_order"))
    rows = pack(base, "old").join(pack(new, "new"), "block_id", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same")
    return rows.select("block_id", change.alias("change"), F.coalesce("new_order", "old_order").alias("rank"))


def missing(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids that no block has."""
    return ids.join(blocks.select("block_id"), "block_id", "left_anti")


def types_of_pairs(base: DataFrame, effective_blocks: DataFrame) -> DataFrame:
    """(document_id, block_types): the sorted types of all pairs of base and effective blocks, that of the effective one first."""
    pick = lambda df, name: df.select("document_id", "block_id", F.coalesce("block_type", F.lit("")).alias(name))
    pairs = pick(base, "old").join(pick(effective_blocks, "new"), ["document_id", "block_id"], "full")
    return pairs.groupBy("document_id").agg(F.sort_array(F.collect_set(F.coalesce("new", "old"))).alias("block_types"))


def load_effective(revisions: DataFrame, documents: DataFrame, evaluations: DataFrame, require_complete: bool = True) -> DataFrame:
    """(document_id, revision_id, source, problem): the effective revision of each document and what keeps it from being
    loaded, null if nothing does.

    documents: revision_id, document_id; evaluations: revision_id, document_id, status, error_count, item_statuses."""
    rows = effective(revisions).join(documents.select("revision_id", F.col("document_id").alias("__doc")), "revision_id", "left")
    judged = evaluations.select("revision_id", F.col("document_id").alias("__eval"), "status", "error_count", "item_statuses", F.lit(True).alias("__judged"))
    rows = review_gate(rows.join(judged, "revision_id", "left"))
    problem = (
        F.when(F.col("__doc").isNull(), "document is missing").when(F.col("__doc") != F.col("document_id"), "revision is of another document")
        .when(F.col("__judged").isNull(), "evaluation is missing").when(~F.col("__eval").eqNullSafe(F.col("__doc")), "evaluation names another document")
        .when(F.lit(require_complete) & ~F.col("passes"), "review is not complete")
    )
    return rows.select("document_id", "revision_id", "source", problem.alias("problem"))
