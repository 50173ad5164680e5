"""Files to documents: the scan, the choice of the adapter, and the one stage in which Python sees bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators import pdf as geometry
from blockloom.sources import html, markdown, office, pdf
from blockloom.sources.model import BLOCK_TYPE, FORMATS, Parsed, document_row, format_of
from blockloom.tables import prepare

#: Fixed value: the largest file that may be sent in.
LARGEST = 200 * 1024 * 1024
SCHEMA = f"path string, document_id string, title string, file_type string, metadata map<string,string>, blocks {BLOCK_TYPE}, error_type string, error string"
Adapter = Callable[[str, bytes], Parsed]
#: The adapters by format; a caller may give others.  The one of PDF gives words with their places, which blocks() joins.
ADAPTERS: dict[str, Adapter] = {"markdown": markdown.parse, "html": html.parse, "docx": office.parse_docx, "xlsx": office.parse_xlsx, "pptx": office.parse_pptx, "pdf": pdf.parse}


def file_type(path) -> F.Column:
    """The format of a path by its suffix in lower case; null if there is no parser."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return known[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = True, output_root: str | None = None, largest: int | None = None) -> DataFrame:
    """(path, length, modificationTime, content, file_type) of the files with a parser, without those under the output
    root or larger than allowed.  The filters are on path and length, so other files aren't read."""
    df = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    df = df.withColumn("file_type", file_type(F.col("path"))).where("file_type is not null")
    if output_root is not None:
        root = re.sub(r"^file:/*", "/", output_root).rstrip("/")
        df = df.where(~F.regexp_replace("path", "^file:/*", "/").startswith(root + "/"))
    return df if largest is None else df.where(F.col("length") <= largest)


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files that were sent in: what is too large or has no parser is left out."""
    return scan(spark, path, largest=LARGEST)


def scan_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Like scan, for given files: one that is missing or has no parser is an error."""
    for f in files:
        format_of(f)
        if not Path(re.sub(r"^file:/*", "/", f)).is_file():
            raise ValueError(f"no such file: {f}")
    return scan(spark, sorted(files))


def parse(files: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """One row a file: its document with blocks, or the error that stopped it; other files go on.

    files: path, content and, if known, inventory_title."""
    table = adapters or ADAPTERS
    if "inventory_title" not in files.columns:
        files = files.withColumn("inventory_title", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, inventory in zip(batch["path"], batch["content"], batch["inventory_title"]):
                try:
                    adapter = table[format_of(path)]
                    rows.append(document_row(path, bytes(content), adapter(path, bytes(content)), inventory))
                except Exception as e:  # noqa: BLE001 - an unreadable file is a result, not the end of the batch
                    rows.append({"path": path, "document_id": None, "title": None, "file_type": None, "metadata": None, "blocks": None, "error_type": type(e).__name__, "error": str(e)})
            yield pd.DataFrame(rows, columns=["path", "document_id", "title", "file_type", "metadata", "blocks", "error_type", "error"])

    return files.select("path", "content", "inventory_title").mapInPandas(run, SCHEMA)


def blocks(documents: DataFrame) -> DataFrame:
    """The blocks of parsed documents, one row each; pos is their order.  Words of pages become lines and paragraphs."""
    rows = documents.where("error is null").select("document_id", (F.col("file_type") == "pdf").alias("__pdf"), F.posexplode("blocks").alias("__i", "b"))
    rows = rows.select("document_id", (F.col("__i") + 1).alias("pos"), "__pdf", "b.*").withColumn("excluded_from_retrieval", F.lit(False))
    others, rows = rows.where("not __pdf").drop("__pdf"), rows.where("__pdf").drop("__pdf")
    words = rows.where("block_type = 'word'").select("document_id", F.col("page_start").alias("page"), "text", "page_height", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "top", "x1", "bottom"))))
    heights = words.groupBy("document_id", "page").agg(F.max("page_height").alias("page_height"))
    texts = geometry.paragraphs(geometry.lines(words.drop("page_height"), heights)).join(heights, ["document_id", "page"])
    texts = texts.withColumn("kind", F.when(F.col("block_type") == "paragraph", "para").otherwise(F.col("block_type")))
    made = texts.select(
        "document_id", F.format_string("%s_p%04d_%s_%04d", "document_id", "page", "kind", "first_line").alias("block_id"), "block_type", "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "bbox",
        F.array().cast("array<string>").alias("heading_path"), "heading_level", "page_height", F.array().cast("array<string>").alias("quality_flags"), F.lit("text_line_group").alias("raw_object_type"), (F.col("first_line") - 1).alias("raw_object_index"),
        F.array().cast("array<string>").alias("ocr_reason_codes"), F.lit(False).alias("excluded_from_retrieval"), F.lit(0).alias("__last"),
    )
    # The order of a PDF document: page by page, first its texts, then its pictures.
    both = rows.where("block_type <> 'word'").withColumn("__last", F.lit(1)).unionByName(made, allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_start", "__last", F.coalesce("raw_object_index", F.lit(0)), "block_id"))
    both = both.withColumn("pos", order).withColumn("block_order", F.col("pos")).drop("__last")
    return others.unionByName(both.select(*others.columns))
