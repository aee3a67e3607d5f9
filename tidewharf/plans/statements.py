"""Run single SQL statements, and what a BI connection may do in a database."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.upload import upload_table


def run_statement(
    spark: SparkSession, statement: str = "show databases", args: Any = None
) -> DataFrame:
    """The rows of one statement, with its columns in the statement's order."""
    return spark.sql(statement.strip().removesuffix(";"), args=args)


@dataclass
class Workspace:
    """A database as a BI connection sees it, with its three permissions."""

    spark: SparkSession
    database: str
    allow_ctas: bool = True
    allow_cvas: bool = True
    allow_file_upload: bool = True

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def create_database(self, *, if_not_exists: bool = True, location: str | None = None) -> None:
        guard = "IF NOT EXISTS " if if_not_exists else ""
        place = f" LOCATION '{location}'" if location else ""
        self.spark.sql(f"CREATE DATABASE {guard}`{self.database}`{place}")

    def drop_database(self, *, cascade: bool = False) -> None:
        """Fails on a database with tables unless ``cascade`` is set."""
        self.spark.sql(
            f"DROP DATABASE IF EXISTS `{self.database}`{' CASCADE' if cascade else ''}"
        )

    def create_table(self, table: str, columns: str) -> None:
        self.spark.sql(f"CREATE TABLE {self._name(table)} ({columns}) USING parquet")

    def show_tables(self) -> DataFrame:
        return self.spark.sql(f"SHOW TABLES FROM `{self.database}`")

    def insert_values(self, table: str, rows: Sequence[Sequence[Any]]) -> None:
        """Insert literal rows."""
        marks = ", ".join(f"({', '.join('?' * len(row))})" for row in rows)
        self.spark.sql(
            f"INSERT INTO {self._name(table)} VALUES {marks}",
            args=[value for row in rows for value in row],
        )

    def create_table_as(self, table: str, query: str) -> None:
        self._require(self.allow_ctas, "CREATE TABLE AS")
        self.spark.sql(f"CREATE TABLE {self._name(table)} USING parquet AS {query}")

    def create_view_as(self, view: str, query: str) -> None:
        self._require(self.allow_cvas, "CREATE VIEW AS")
        self.spark.sql(f"CREATE VIEW {self._name(view)} AS {query}")

    def upload(self, path: str, table: str, **options: Any) -> None:
        self._require(self.allow_file_upload, "file upload")
        upload_table(self.spark, path, self._name(table), **options)

    def _require(self, allowed: bool, what: str) -> None:
        if not allowed:
            raise PermissionError(f"{what} is not allowed in database {self.database}")
