"""Publish runs by lists of their files, for stores on which a rename is not atomic.

A run writes its files to a folder of its own, ``<path>/data/load=<id>``, where no reader looks.
When they are complete, one small file under ``<path>/_runs`` is made, by a single call that
fails if its name is taken. It lists the files of the run (for an appending run those of
the run before as well), their schema and format. Readers open the newest list and only
the files in it. So a run that stops at any point before that call has changed nothing, and of two
writers that start from the same run one is refused.

Without a run stamp, lists are numbered; with one, the stamp is the name of the list, and every
stamped run is read by itself.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from .publish import create_once, filesystem, read_text

RUNS, DATA, LOAD = "_runs", "data", "load"
_NUMBERED = re.compile(r"v\d{20}")


class RunRefused(FileExistsError):
    """Another run was published first."""


def published_runs(spark: SparkSession, path: str) -> list[str]:
    """The names of the published runs, the oldest first."""
    fs, folder = filesystem(spark, f"{path.rstrip('/')}/{RUNS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(name.removesuffix(".json") for name in names
                  if name.endswith(".json") and not name.startswith("."))


def run_list(spark: SparkSession, path: str, run: str | None = None) -> dict[str, Any]:
    """What a run's list says: ``files`` relative to ``path``, ``rows_schema``, ``format``, ``options``."""
    runs = published_runs(spark, path)
    if run is None and not runs or run is not None and run not in runs:
        raise LookupError(f"no published run {run or ''} under {path}")
    return json.loads(read_text(spark, f"{path.rstrip('/')}/{RUNS}/{run or runs[-1]}.json"))


def read_run(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The rows of a published run, by default the newest, with the columns they were written with."""
    listed = run_list(spark, path, run)
    schema = T.StructType.fromJson(listed["rows_schema"])
    if not listed["files"]:
        return spark.createDataFrame([], schema)
    path = path.rstrip("/")
    reader = spark.read.format(listed["format"]).schema(schema).options(**listed["options"])
    return reader.option("basePath", f"{path}/{DATA}").load(
        [f"{path}/{file['name']}" for file in listed["files"]]).select(*[f"`{c}`" for c in schema.names])


def publish_run(
    df: DataFrame, path: str, write: Callable[[str], None], fmt: str, options: Mapping[str, str],
    *, mode: str = "errorifexists", stamp: str | None = None, partition_by: Sequence[str] = (),
    label: str | None = None,
) -> str:
    """Write a run with ``write(folder)`` and publish it; returns the name of its list.

    A run whose ``label`` is in a list was published before and is not written again. Numbered lists
    carry the labels on, so the newest is enough to tell.
    """
    if LOAD in df.columns:
        raise ValueError(f"a published table cannot have a column {LOAD}")
    spark, path = df.sparkSession, path.rstrip("/")
    runs = published_runs(spark, path)
    labels = {}
    if label is not None and runs:
        known = runs if stamp is None else [run for run in runs if run == stamp]
        labels = run_list(spark, path, known[-1]).get("labels", {}) if known else {}
        if label in labels:
            return labels[label]
    if stamp is None:
        if runs and not _NUMBERED.fullmatch(runs[-1]):
            raise ValueError(f"{path} holds stamped runs; publish with a stamp")
        name = f"v{int(runs[-1][1:]) + 1 if runs else 1:020d}"
        if runs and mode == "errorifexists":
            raise FileExistsError(path)
    else:
        if runs and _NUMBERED.fullmatch(runs[-1]):
            raise ValueError(f"{path} holds numbered runs; publish without a stamp")
        name = stamp
        if stamp in runs and mode not in ("ignore",):
            raise RunRefused(f"run {stamp} of {path} is published")
    if mode == "ignore" and (runs if stamp is None else stamp in runs):
        return runs[-1] if stamp is None else stamp
    files: list[dict[str, Any]] = []
    if mode == "append" and stamp is None and runs:
        before = run_list(spark, path, runs[-1])
        schema = T.StructType.fromJson(before["rows_schema"])
        if schema.simpleString() != df.schema.simpleString() or before["format"] != fmt:
            raise ValueError(f"the runs of {path} have another schema or format")
        files += before["files"]
    folder = f"{DATA}/{LOAD}={uuid.uuid4().hex}"
    try:
        write(f"{path}/{folder}")
        files += _files(spark, path, folder)
        published = create_once(spark, f"{path}/{RUNS}/{name}.json", json.dumps({
            "run": name, "format": fmt, "options": dict(options),
            "rows_schema": df.schema.jsonValue(), "partition_by": list(partition_by), "files": files,
            "labels": {**labels, **({label: name} if label is not None else {})}}))
    except Exception:
        _remove(spark, f"{path}/{folder}")
        raise
    if not published:
        _remove(spark, f"{path}/{folder}")
        raise RunRefused(f"another run {name} of {path} was published first")
    return name


def remove_unlisted(spark: SparkSession, path: str, older_than_s: int = 7 * 86_400) -> list[str]:
    """Delete folders of runs that no list names; runs that may still be writing are younger."""
    path = path.rstrip("/")
    fs, data = filesystem(spark, f"{path}/{DATA}")
    if not fs.exists(data):
        return []
    named = {file["name"].split("/")[1] for run in published_runs(spark, path)
             for file in run_list(spark, path, run)["files"]}
    gone = []
    for status in fs.listStatus(data):
        name = status.getPath().getName()
        if name not in named and status.getModificationTime() < (time.time() - older_than_s) * 1000:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def _files(spark: SparkSession, path: str, folder: str) -> list[dict[str, Any]]:
    """The data files below a folder, their names relative to ``path``."""
    fs, base = filesystem(spark, f"{path}/{folder}")
    found, listing = [], fs.listFiles(base, True)
    while listing.hasNext():
        status = listing.next()
        # As the path has it: a name in a URI would have its percent signs encoded.
        name = status.getPath().toString().split(f"{folder}/", 1)[1]
        if not any(part.startswith((".", "_")) and "=" not in part for part in name.split("/")):
            found.append({"name": f"{folder}/{name}", "bytes": status.getLen()})
    return sorted(found, key=lambda file: file["name"])


def _remove(spark: SparkSession, folder: str) -> None:
    fs, place = filesystem(spark, folder)
    fs.delete(place, True)
