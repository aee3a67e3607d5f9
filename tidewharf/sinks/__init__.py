from .directories import read_directories
from .files import file_sink, latest_run
from .jdbc import Database, jdbc_sink
from .ledger import load_once
from .lists import RunRefused, published_runs, read_run, remove_unlisted, run_list
from .tables import (
    cast_unsupported_types, merge_changes, overwrite_table, replace_table, table_sink,
)

__all__ = [
    "Database",
    "RunRefused",
    "cast_unsupported_types",
    "file_sink",
    "jdbc_sink",
    "latest_run",
    "load_once",
    "merge_changes",
    "overwrite_table",
    "published_runs",
    "read_directories",
    "read_run",
    "remove_unlisted",
    "replace_table",
    "run_list",
    "table_sink",
]
