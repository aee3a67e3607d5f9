from .datagen import generate, table_rows
from .runner import run_benchmark, save_results, summarize

__all__ = ["generate", "run_benchmark", "save_results", "summarize", "table_rows"]
