from .job import (
    FileSink, JdbcSink, JdbcSource, Job, ParquetSource, SqlTransform, TableSink, sql_transform,
)
from .statements import Workspace, run_statement

__all__ = [
    "FileSink",
    "JdbcSink",
    "JdbcSource",
    "Job",
    "ParquetSource",
    "SqlTransform",
    "TableSink",
    "Workspace",
    "run_statement",
    "sql_transform",
]
