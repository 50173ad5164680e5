"""Reading what was written: documents as JSON, lists of blocks, append-only logs, settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import validate

_TABLE = "struct<caption:string,headers:array<string>,rows:array<array<string>>,notes:array<string>>"
_IMAGE = "struct<image_id:string,caption:string,ocr_text:string,image_path:string,width:double,height:double>"
_TRACE = "struct<parser:string,raw_object_type:string,raw_object_index:int,raw_page_index:int,raw_sheet_name:string,raw_slide_index:int,raw_locator:string>"
BLOCK = f"struct<block_id:string,document_id:string,block_type:string,text:string,table_data:{_TABLE},image:{_IMAGE},page_start:int,page_end:int,bbox:array<double>,heading_path:array<string>,heading_level:int,metadata:string,source_trace:{_TRACE},quality_flags:array<string>,block_order:int>"
DOCUMENT = f"struct<document_id:string,title:string,file_type:string,source_path:string,source_url:string,metadata:string,parsed_at:string,blocks:array<{BLOCK}>>"


def documents_of(texts: DataFrame, column: str = "json") -> DataFrame:
    """Documents of JSON texts; ``ok`` is false where a text is no document."""
    parsed = F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"})
    rows = texts.withColumn("__d", parsed)
    return rows.withColumn("ok", F.col("__d.document_id").isNotNull() & F.col("__d.blocks").isNotNull()).select("ok", "__d.*")


def blocks_of(documents: DataFrame) -> DataFrame:
    """The blocks of documents, each under its document's id as well as its own word for it."""
    rows = documents.where("ok").select(F.col("document_id").alias("of_document"), F.posexplode("blocks").alias("pos", "b"))
    return rows.select("of_document", "pos", "b.*")


def strict(documents: DataFrame, schema_version: str = validate.SCHEMA_VERSION) -> DataFrame:
    """(document_id, violation): what keeps documents from being loaded; none means all may be."""
    bad = documents.where("not ok").select(F.lit(None).cast("string").alias("document_id"), F.lit("no document").alias("violation"))
    good = documents.where("ok")
    blocks = blocks_of(good)
    foreign = blocks.where(F.col("document_id").isNotNull() & (F.col("document_id") != F.col("of_document"))).select(F.col("of_document").alias("document_id"), F.lit("a block names another document").alias("violation"))
    twice = validate.duplicate_ids(blocks.withColumn("document_id", F.col("of_document"))).select("document_id", F.lit("block_id comes twice").alias("violation"))
    own = validate.block_violations(blocks.withColumn("document_id", F.col("of_document"))).select("document_id", "violation")
    return bad.unionByName(validate.document_violations(good, schema_version)).unionByName(foreign).unionByName(twice).unionByName(own).distinct()


def block_list(column: Column | str) -> Column:
    """The blocks of a JSON text that is a document or a bare list; what is no object gives nothing."""
    c = F.col(column) if isinstance(column, str) else column
    either = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{BLOCK}>")).otherwise(F.from_json(c, f"struct<blocks:array<{BLOCK}>>")["blocks"])
    return F.filter(F.coalesce(either, F.array().cast(f"array<{BLOCK}>")), lambda b: b.isNotNull())


def read_log(spark: SparkSession, path: str, schema: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """An append-only log of JSON lines; blank lines are none. With key and value only the records of one key."""
    df = spark.read.schema(schema).json(path)
    return df if key is None else df.where(F.col(key) == value)


def settings(path: str) -> None:
    """Settings of a file of NAME=value lines into the environment, unless they are there; # begins a comment."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
