"""The whole way from files to evaluated documents, as one plan: bytes to blocks once, one exchange by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import clean, ocr, quality, repair, review
from blockloom.sources import files


@dataclass(frozen=True)
class Result:
    documents: DataFrame
    blocks: DataFrame
    warnings: DataFrame
    evaluations: DataFrame
    candidates: DataFrame
    failures: DataFrame


def process(blocks: DataFrame) -> DataFrame:
    """Cleaned and repaired blocks.  All its windows are keyed by document: distribute the blocks by it once before."""
    return repair.repair(clean.clean(blocks))


def prepared(blocks: DataFrame) -> DataFrame:
    """Rows of a table of blocks as the operators take them: each block once, pos as its order, distributed by document.

    Copies of a block share its document, so the one exchange that the operators need also serves to drop them."""
    once = blocks.repartition("document_id").dropDuplicates(["document_id", "block_id"])
    return once.withColumn("pos", F.col("block_order"))


def warnings_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """Warnings of the flags a parser set, also of blocks that cleaning removed, then those of the final flags; equal ones once."""
    early = quality.flag_warnings(before).withColumn("phase", F.lit(0))
    return quality.first_warnings(early.unionByName(quality.flag_warnings(after)))


def evaluate(before: DataFrame, after: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Evaluations; with the documents also of those that have no block (left)."""
    return quality.evaluations(after, warnings_of(before, after), documents=documents)


def finalize(blocks: DataFrame, states: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs with status and reason, final blocks, evaluations): what review replaced is put in, then the documents of
    completed runs are cleaned, repaired and judged again."""
    runs = review.finalization(blocks, states)
    whole = review.finalize(blocks, states, replacements)
    before = whole.withColumn("pos", F.col("block_order")).repartition("document_id")
    after = process(before)
    return runs, after, evaluate(before, after, runs.where("run_status = 'completed'"))


def parse_directory(spark: SparkSession, path: str, recursive: bool = True, output_root: str | None = None, adapters: dict | None = None) -> Result:
    """Files of a folder to documents, blocks, warnings, evaluations, OCR candidates and failures."""
    return run(files.parse(files.scan(spark, path, recursive, output_root), adapters))


def parse_files(spark: SparkSession, paths: list[str], adapters: dict | None = None) -> Result:
    return run(files.parse(files.scan_files(spark, paths), adapters))


def run(documents: DataFrame) -> Result:
    # The same file under two paths is one document.
    ok = documents.where("error is null").dropDuplicates(["document_id"])
    before = files.blocks(ok).repartition("document_id")
    after = process(before)
    return Result(ok, after, warnings_of(before, after), evaluate(before, after, ok), ocr.candidates(after), documents.where("error is not null").select("path", "error_type", "error"))
