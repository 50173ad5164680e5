"""Where the bytes of an image block are, decided without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asset_state() -> Column:
    """struct(status, reason_code, media_type) from file_type, image and raw_locator."""
    path = F.col("image.image_path")
    state = lambda s, code: F.struct(F.lit(s).alias("status"), F.lit(code).cast("string").alias("reason_code"), F.lit(None).cast("string").alias("media_type"))
    data = F.struct(F.lit("inline").alias("status"), F.lit(None).cast("string").alias("reason_code"), F.regexp_extract(path, r"^data:([^;,]*)", 1).alias("media_type"))
    linked = (
        F.when(F.coalesce(path, F.lit("")) == "", state("missing", "IMAGE_REFERENCE_MISSING")).when(F.lower(path).rlike("^https?://"), state("missing", "REMOTE_IMAGE_REQUIRES_FETCH_POLICY")).when(F.lower(path).startswith("data:"), data)
        .when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]+:"), state("missing", "UNSUPPORTED_IMAGE_URI")).when(path.rlike(r"(^|/)\.\.(/|$)") | path.startswith("/"), state("missing", "IMAGE_PATH_OUTSIDE_SOURCE_ROOT")).otherwise(state("local", None))
    )
    return (
        F.when(F.col("file_type").isin("html", "markdown"), linked)
        .when(F.col("file_type") == "docx", F.when(F.coalesce(path, F.lit("")) == "", state("missing", "DOCX_IMAGE_PART_MISSING")).otherwise(state("member", None)))
        .when(F.col("file_type") == "pptx", F.when(F.col("raw_locator").isNull(), state("missing", "PPTX_PICTURE_LOCATOR_MISSING")).otherwise(state("member", None)))
        .when(F.col("file_type") == "xlsx", F.when(F.coalesce(path, F.lit("")) == "", state("missing", "XLSX_IMAGE_LOCATOR_MISSING")).otherwise(state("member", None)))
        .otherwise(state("missing", "UNSUPPORTED_IMAGE_SOURCE"))
    )


def inline_bytes(images: DataFrame) -> DataFrame:
    """(block_id, content) of pictures written as data: links; what is no base64 gives null."""
    return images.where(F.lower("image.image_path").startswith("data:")).select("block_id", F.try_to_binary(F.regexp_extract("image.image_path", r"^[^,]*,(.*)$", 1), F.lit("base64")).alias("content"))
