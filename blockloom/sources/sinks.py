"""Writing stages, logs, queues and exports."""

from __future__ import annotations

import csv
import io
import os
from pathlib import Path

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """A stage of a run as parquet, one folder a run: rewriting a run leaves the others."""
    path = f"{root}/{stage}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds records to an append-only log; each keeps its seq."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A folder of CSV files with exactly these columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_queue(df: DataFrame, path: str, columns: list[str], most: int = 100_000) -> None:
    """One CSV file with a byte-order mark for a spreadsheet, put in place at once; for queues people read, so of bounded length."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a queue file holds at most {most} rows; use write_csv")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns)
    writer.writerows(rows)
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(out.getvalue(), encoding="utf-8-sig", newline="")
    os.replace(part, target)


def export(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Texts of documents, one folder each."""
    df.write.mode("overwrite").partitionBy(by).text(path)
