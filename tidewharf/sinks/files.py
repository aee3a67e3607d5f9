"""Write a DataFrame as files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .directories import placeholders, write_directories
from .gather import gathered
from .lists import RUNS, publish_run
from .publish import exists, filesystem, publish

FORMATS = ("csv", "json", "orc", "parquet", "text", "xml")
ROW_DELIMITERS = ("\n", "\r\n")


def file_sink(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    *,
    field_delimiter: str = ",",
    row_delimiter: str = "\n",
    header: bool = False,
    null_value: str = "",
    codec: str = "none",
    columns: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    keep_partition_columns: bool = False,
    directory: str | None = None,
    directory_columns: Mapping[str, str] | None = None,
    rebalance: bool = True,
    max_rows_per_file: int = 10_000_000,
    run_stamp: str | None = None,
    now: datetime | None = None,
    tmp_path: str | None = None,
    transaction: bool = False,
    listed: bool = False,
    label: str | None = None,
    mode: str = "errorifexists",
) -> str:
    """Write ``df`` under ``path`` and return the directory written.

    fmt                     csv, json, orc, parquet or xml; "text" means csv
    columns                 write these columns, in this order
    null_value              text for null in csv; the default reads back the same for
                            null and for an empty string, "\\N" keeps them apart
    partition_by            one directory per value; ``rebalance`` first gathers
                            the rows of a value into a few tasks, and Spark splits
                            a value that is too large for one
    keep_partition_columns  leave the columns in the files too; the directories
                            are then called ``by_<column>=``
    directory               an expression such as ``${year}/${status}`` for the directories,
                            instead of ``partition_by``; names that are no columns are
                            SQL in ``directory_columns``. Read with ``read_directories``;
                            always staged, so not for appending
    run_stamp               strftime pattern; the output goes to ``path/run=<stamp>``
    tmp_path, transaction   write elsewhere first and move the finished directory
                            into place, so a failed run leaves the target as it was
    listed                  publish the run by a list of its files, atomic on object stores
                            too; read with ``read_run``. Every mode can be used, the
                            returned directory is ``path``
    label                   publish a listed run once, however often it is tried
    mode                    errorifexists, overwrite, ignore or append
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}, expected one of {', '.join(FORMATS)}")
    if row_delimiter not in ROW_DELIMITERS:
        raise ValueError("row delimiter must be \\n or \\r\\n")
    staged = transaction or tmp_path is not None or directory is not None
    if directory is not None and partition_by:
        raise ValueError("give either a directory expression or partition columns")
    if label is not None and not listed:
        raise ValueError("a label needs a listed run")
    if staged and listed:
        raise ValueError("a listed run needs no staging")
    if staged and mode == "append":
        raise ValueError("a staged write replaces its directory; append with run_stamp instead")

    spark, stamp = df.sparkSession, None
    if run_stamp is not None:
        if not _sorts(run_stamp):
            raise ValueError(f"run stamps {run_stamp!r} do not sort by time, year first is needed")
        now = now or datetime.now(timezone.utc)
        stamp = now.strftime(run_stamp)
        path = path if listed else run_path(path, run_stamp, now)
    if columns is not None:
        by = partition_by
        if directory is not None:
            by = [n for n in placeholders(directory) if n not in (directory_columns or {})]
        df = df.select(*columns, *[c for c in by if c not in columns])
    directories = list(partition_by)
    if directories and keep_partition_columns:
        directories = [f"by_{c}" for c in partition_by]
        df = df.withColumns({f"by_{c}": F.col(c) for c in partition_by})
    if rebalance:
        df = gathered(df, directories)

    fmt = "csv" if fmt == "text" else fmt
    options = {"compression": codec, "maxRecordsPerFile": str(max_rows_per_file)}
    if fmt == "csv":
        options.update(
            sep=field_delimiter, lineSep=row_delimiter, header=str(header).lower(),
            nullValue=null_value,
        )
    elif fmt == "json":
        options.update(lineSep=row_delimiter)
    elif fmt == "xml":
        options.update(rowTag="row", rootTag="rows")

    def save(rows: DataFrame, to: str, how: str, by: Sequence[str]) -> None:
        writer = rows.write.format(fmt).options(**options).mode(how)
        (writer.partitionBy(*by) if by else writer).save(to)

    def write(to: str, how: str) -> None:
        save(df, to, how, directories)

    if listed:
        publish_run(df, path, lambda folder: write(folder, "errorifexists"), fmt, options,
                    mode=mode, stamp=stamp, partition_by=directories, label=label)
        return path
    if not staged:
        write(path, mode)
        return path
    if mode != "overwrite" and exists(spark, path):
        if mode == "ignore":
            return path
        raise FileExistsError(path)
    if directory is not None:
        write_directories(
            df, path, directory,
            lambda rows, to, by: save(
                gathered(rows, by) if rebalance else rows, to, "errorifexists", by),
            expressions=directory_columns, keep_columns=keep_partition_columns, tmp_path=tmp_path)
        return path
    # A dot keeps readers of the parent directory from seeing unfinished files.
    staging = tmp_path or path.rstrip("/").rsplit("/", 1)[0]
    target = f"{staging.rstrip('/')}/.staged-{uuid.uuid4().hex[:12]}"
    try:
        write(target, "errorifexists")
        publish(spark, target, path)
    except Exception:
        fs, unfinished = filesystem(spark, target)
        fs.delete(unfinished, True)
        raise
    return path


def run_path(path: str, run_stamp: str, now: datetime) -> str:
    return f"{path.rstrip('/')}/run={now.strftime(run_stamp)}"


def _sorts(pattern: str) -> bool:
    """Whether texts of the pattern are in the order of their times."""
    times = [
        datetime(2019 + i // 24, i // 2 % 12 + 1, 9 + i % 2 * 11, i % 2 * 12 + 4, i % 2 * 30 + 7, i % 2)
        for i in range(72)
    ] + [datetime(2022, 1, 1, hour, minute) for hour in range(24) for minute in (5, 40)]
    stamps = [time.strftime(pattern) for time in times]
    return stamps == sorted(stamps)


def latest_run(spark: SparkSession, path: str) -> str | None:
    """The newest finished ``run=`` directory under ``path``."""
    fs, base = filesystem(spark, path)
    if not fs.exists(base):
        return None
    if exists(spark, f"{path.rstrip('/')}/{RUNS}"):
        raise ValueError(f"the runs of {path} are lists of files; use read_run")
    runs = [
        status.getPath().toString()
        for status in fs.listStatus(base)
        if status.getPath().getName().startswith("run=")
    ]
    finished = [run for run in runs if exists(spark, f"{run}/_SUCCESS")]
    return max(finished, default=None)
