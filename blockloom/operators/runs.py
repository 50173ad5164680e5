"""Runs, jobs and their files: manifests, progress, overlays of later revisions, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a file is done.
DONE = ("finalized", "review_required", "failed", "cancelled")


def manifests(stages: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(run_id, status, last_completed_stage, n_stages) from the log of stages (run_id, stage, seq)."""
    out = stages.groupBy("run_id").agg(F.max_by("stage", "seq").alias("last_completed_stage"), F.count("*").alias("n_stages"))
    if failures is None:
        return out.withColumn("status", F.lit("completed"))
    return out.join(failures.select("run_id").distinct().withColumn("failed", F.lit(True)), "run_id", "left").withColumn("status", F.when(F.col("failed"), "failed").otherwise("completed")).drop("failed")


def progress(files: DataFrame) -> DataFrame:
    """(job_id, total, completed, one count a state) from files (job_id, status)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return files.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*DONE)).alias("completed"), *(n(s) for s in DONE))


def overlay(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Files with the state and block count of their document's effective revision where it isn't the base run."""
    later = revisions.where("source <> 'base_run'").select("document_id", F.col("status").alias("__s"), F.col("block_count").alias("__n"), F.col("source").alias("revision_source"))
    return files.join(later, "document_id", "left").withColumn("status", F.coalesce("__s", "status")).withColumn("block_count", F.coalesce("__n", "block_count")).drop("__s", "__n")


def unfinished(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that a cancelled batch never came to, as cancelled."""
    return files.join(done.select("path").distinct(), "path", "left_anti").withColumn("status", F.lit("cancelled"))


def with_jobs(states: DataFrame, files: DataFrame) -> DataFrame:
    """Review states (run_dir, document_id, ...) with the job and the name of the file of their run, whatever the case of the folder."""
    key = lambda c: F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))
    jobs = files.where("run_dir <> ''").groupBy(key(F.col("run_dir")).alias("__run")).agg(F.max("job_id").alias("web_job_id"), F.max("filename").alias("__name"))
    rows = states.withColumn("__run", key(F.col("run_dir"))).join(jobs, "__run", "left")
    return rows.withColumn("web_job_id", F.coalesce("web_job_id", F.lit(""))).withColumn("source_filename", F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.col("document_id"))).drop("__run", "__name")


#: States of a job that hasn't ended.
OPEN = ("queued", "running", "stopping")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status) from a log of events (job_id, seq, event): submitted, started, cancel_asked, cancelled, finished,
    failed, restarted.  A job still open at a restart was interrupted; what is asked of a job that has ended changes nothing."""
    is_ = lambda *names: F.col("event").isin(*names)
    last = lambda *names: F.max(F.when(is_(*names), F.col("seq")))
    rows = events.groupBy("job_id").agg(
        F.max_by("event", F.when(is_("cancelled", "finished", "failed"), F.col("seq"))).alias("end"), last("cancelled", "finished", "failed").alias("ended"), last("restarted").alias("restarted"), last("started").alias("started"), last("cancel_asked").alias("asked"),
        F.min("seq").alias("submitted"),
    )
    status = (
        F.when(F.col("ended").isNotNull() & (F.col("ended") < F.coalesce("restarted", F.lit(2**62))), F.when(F.col("end") == "finished", "completed").otherwise(F.col("end")))
        .when(F.col("restarted") > F.col("submitted"), "interrupted").when(F.col("asked").isNotNull() & F.col("started").isNull(), "cancelled")
        .when(F.col("asked").isNotNull(), "stopping").when(F.col("started").isNotNull(), "running").otherwise("queued")
    )
    return rows.select("job_id", status.alias("status"))


def retry(files: DataFrame, job_id: str, new_job_id: str) -> DataFrame:
    """The failed files of a job, queued as a new one."""
    return files.where((F.col("job_id") == job_id) & (F.col("status") == "failed")).select(F.lit(new_job_id).alias("job_id"), "path", F.lit("queued").alias("status"))


def events(results: DataFrame) -> DataFrame:
    """(job_id, type, path, status): progress of jobs from files (job_id, path, status): the batch begins, each file begins
    and, if it is done, ends; the batch ends with its last file."""
    of = lambda rows, kind, path, status: rows.select("job_id", F.lit(kind).alias("type"), path.alias("path"), status.alias("status"))
    none = F.lit(None).cast("string")
    jobs = results.groupBy("job_id").agg(F.min(F.coalesce(F.col("status").isin(*DONE), F.lit(False))).alias("all"), F.max(F.col("status") == "cancelled").alias("stopped"))
    begun, done = results.where("status not in ('queued', 'cancelled')"), results.where(F.col("status").isin(*DONE))
    return (
        of(jobs, "batch_started", none, none).unionAll(of(begun, "file_started", F.col("path"), none)).unionAll(of(done, "file_completed", F.col("path"), F.col("status")))
        .unionAll(of(jobs.where("all"), "batch_finished", none, F.when(F.col("stopped"), "cancelled").otherwise("completed")))
    )


def execution_state(results: DataFrame) -> DataFrame:
    """(run_id, succeeded, failed, status) of a bulk execution from results (run_id, error_type)."""
    out = results.groupBy("run_id").agg(F.count_if(F.col("error_type").isNull()).alias("succeeded"), F.count_if(F.col("error_type").isNotNull()).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def picture_decisions(pictures: DataFrame, pages: DataFrame, candidates: tuple = ("auto_ocr_candidate", "manual_review", "auto_ocr", "review_before_ocr")) -> DataFrame:
    """Pictures of pages (document_id, page, area_ratio) with their page's decision; a flag if the page is a candidate."""
    rows = pictures.join(pages.select("document_id", "page", F.col("decision").alias("ocr_decision"), F.col("reason_code").alias("ocr_reason_code")), ["document_id", "page"], "left")
    flag = F.when(F.col("ocr_decision").isin(*candidates), F.array("ocr_decision")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("quality_flags", flag).withColumn("excluded_from_retrieval", F.lit(True)).withColumn("area_ratio", F.round("area_ratio", 6))


def page_warnings(pages: DataFrame) -> DataFrame:
    """A warning for each page that is a candidate for OCR."""
    rows = pages.where(F.col("decision").isin("auto_ocr", "review_before_ocr"))
    return rows.select("document_id", F.lit("warning").alias("level"), F.col("decision").alias("warning_type"), F.col("page").alias("page_number"), F.col("reason_code").alias("message"))


def _escaped(c: Column) -> Column:
    t = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def table_preview(table: Column | str, rows: int = 100, columns: int = 30) -> Column:
    """The first rows and columns of a table as an HTML table, escaped: a preview, so cut by intent."""
    t = F.col(table) if isinstance(table, str) else table
    every = F.concat(F.array(F.coalesce(t["headers"], F.array().cast("array<string>"))), F.coalesce(t["rows"], F.array().cast("array<array<string>>")))
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.slice(r, 1, columns), lambda c: F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(F.slice(every, 1, rows), line), ""), F.lit("</table>"))


def first_of_each(blocks: DataFrame, n: int = 30) -> DataFrame:
    """The first n blocks of each document, for a preview."""
    return blocks.withColumn("__n", F.row_number().over(Window.partitionBy("document_id").orderBy("block_order", "block_id"))).where(F.col("__n") <= n).drop("__n")
