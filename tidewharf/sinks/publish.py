"""Move a finished directory into place.

A rename is atomic on HDFS and on local disks. On object stores it copies, so
there publish by lists of files instead (``lists.py``).
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path itself as Hadoop's class."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put ``staged`` at ``target``; what was there is removed only after that.

    If the driver dies between the two moves, the old data lie beside the target
    under ``<target>.previous-<id>``.
    """
    fs, new = filesystem(spark, staged)
    target_fs, place = filesystem(spark, target)
    if fs.getUri().toString() != target_fs.getUri().toString():
        raise ValueError(f"{staged} and {target} are on different file systems")
    if place.getParent() is not None:
        fs.mkdirs(place.getParent())
    if not fs.exists(place):
        _rename(fs, new, place)
        return
    previous = spark._jvm.org.apache.hadoop.fs.Path(
        f"{target.rstrip('/')}.previous-{uuid.uuid4().hex[:12]}"
    )
    _rename(fs, place, previous)
    try:
        _rename(fs, new, place)
    except Exception:
        _rename(fs, previous, place)
        raise
    fs.delete(previous, True)


# Stores on which a rename moves a whole file at once and fails if the target is there.
_RENAMING = {"hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs", "o3fs"}


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with this text, whole and at once; False if there is one already.

    On local disks a finished file gets its name by a link, on HDFS and its like by a rename;
    both fail if the name is taken. Object stores show a new object when it is
    complete, and refuse one that exists if the connector writes conditionally (for ``s3a``,
    ``fs.s3a.create.conditional.enabled``, the default of current versions).
    """
    fs, target = filesystem(spark, path)
    scheme = fs.getUri().getScheme()
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    unfinished = f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex[:12]}"
    if scheme == "file":
        name = spark._jvm.org.apache.hadoop.fs.Path(unfinished).toUri().getPath()
        with open(name, "x", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(name, target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            os.unlink(name)
        return True
    if scheme in _RENAMING:
        place = spark._jvm.org.apache.hadoop.fs.Path(unfinished)
        _write(fs.create(place, False), text)
        done = fs.rename(place, target)
        if not done:
            fs.delete(place, False)
        return done
    try:
        _write(fs.create(target, False), text)
    except Py4JJavaError as error:
        if fs.exists(target):
            return False
        raise error
    return True


def _write(stream, text: str) -> None:
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, place = filesystem(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
