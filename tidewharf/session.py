"""Session settings for local runs, and the scratch area shared by executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "tidewharf", **conf: str) -> SparkSession:
    """A one-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Dderby.stream.error.file=/dev/null")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Change settings of the session and put them back afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_local_scratch: dict[str, str] = {}
_databases: dict[str, list[str]] = {}
_cleanups: dict[str, list[Callable[[], None]]] = {}


def at_clearing(spark: SparkSession, action: Callable[[], None]) -> None:
    """Run ``action`` when this application's scratch data are cleared."""
    _cleanups.setdefault(spark.sparkContext.applicationId, []).append(action)


def _base(spark: SparkSession) -> str:
    """The folder that the driver, all executors and later applications share."""
    application = spark.sparkContext.applicationId
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        if application not in _local_scratch:
            _local_scratch[application] = tempfile.mkdtemp(prefix="tidewharf-")
        base = _local_scratch[application]
    return base.rstrip("/")


def _application_scratch(spark: SparkSession) -> str:
    return f"{_base(spark)}/tidewharf-{spark.sparkContext.applicationId}"


def lasting_dir(spark: SparkSession, name: str) -> str:
    """A folder beside the scratch data that ``clear_scratch`` leaves, the same for every application."""
    return f"{_base(spark)}/tidewharf-lasting/{name}"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster it
    is an error, because executors do not share the driver's disk.
    """
    return f"{_application_scratch(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def scratch_database_name(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Name and location for a new database, which ``clear_scratch`` will drop."""
    location = scratch_dir(spark, purpose)
    name = "scratch_" + location.rsplit("/", 1)[1].replace("-", "_")
    _databases.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name, location


def scratch_database(spark: SparkSession, purpose: str) -> str:
    """A new, empty database whose tables live in the shared scratch area."""
    name, location = scratch_database_name(spark, purpose)
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{location}'")
    return name


def clear_scratch(spark: SparkSession) -> None:
    """Drop this application's scratch databases and delete its scratch folder.

    Call it once no result that reads them is needed any more.
    """
    for action in _cleanups.pop(spark.sparkContext.applicationId, []):
        action()
    for name in _databases.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    folder = spark._jvm.org.apache.hadoop.fs.Path(_application_scratch(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
