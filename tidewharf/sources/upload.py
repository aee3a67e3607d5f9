"""Load a delimited file as a table."""

from __future__ import annotations

from pyspark.sql import SparkSession


def upload_table(
    spark: SparkSession,
    path: str,
    table: str,
    *,
    schema: str | None = None,
    header: bool = True,
    delimiter: str = ",",
    save_mode: str = "errorifexists",
    **options: str,
) -> None:
    """Create ``table`` from the file(s) at ``path``.

    A malformed row or a header that is not the schema's columns in order is an error;
    reader options, among them ``mode`` and ``enforceSchema``, say otherwise. Give
    ``schema`` for anything large: inferring it reads the file once more.
    """
    strict = {"mode": "FAILFAST", "enforceSchema": "false"}
    reader = spark.read.options(header=header, sep=delimiter, **(strict | options))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    reader.csv(path).write.mode(save_mode).saveAsTable(table)
