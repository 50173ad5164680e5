"""Files and logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators import review
from blockloom.plans import pipeline
from blockloom.sources import files
from blockloom.tables import prepare


def stream_directory(spark: SparkSession, path: str, sink: Callable[[pipeline.Result, int], None], checkpoint: str, per_batch: int = 1000, adapters: dict | None = None, once: bool = False) -> StreamingQuery:
    """New files of a folder, a bounded number at a time, through the pipeline; the checkpoint keeps what was done."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    new = prepare(spark).readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    new = new.where(files.file_type(F.col("path")).isNotNull())

    def batch(df: DataFrame, number: int) -> None:
        sink(pipeline.run(files.parse(df, adapters)), number)

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


LOG = "seq bigint, decision_id string, review_id string, selected_action string, reviewer string"


def stream_states(spark: SparkSession, log: str, checkpoint: str, sink: Callable[[DataFrame, int], None], per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """The latest decision of each review as a log of JSON records grows, whatever order its records come in.

    The state is one record a review (its highest seq); it needs no watermark, as a decision never expires."""
    rows = prepare(spark).readStream.schema(LOG).option("maxFilesPerTrigger", per_batch).json(log)
    states = rows.where("review_id is not null and seq is not null").groupBy("review_id").agg(F.max_by(F.struct("seq", "decision_id", "selected_action", "reviewer"), "seq").alias("d")).select("review_id", "d.*")
    status = F.when(F.col("selected_action").isin(*review.ASKS_OCR), "ocr_requested").otherwise("decided")
    writer = states.withColumn("status", status).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
