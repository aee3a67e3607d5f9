from .changes import apply_changes
from .distinct import distinct_numbers
from .median import median_by
from .readiness import readiness
from .running import day_slices, rows_per_day, running_sum
from .slices import slices_for, with_totals
from .stored import stored
from .tagging import Rule, tag_rows

__all__ = [
    "Rule",
    "apply_changes",
    "day_slices",
    "distinct_numbers",
    "median_by",
    "readiness",
    "rows_per_day",
    "running_sum",
    "slices_for",
    "stored",
    "tag_rows",
    "with_totals",
]
