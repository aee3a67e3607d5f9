"""DuckDB statements that give the expected rows for every checked query."""

from .jobs import ORACLES as _JOBS
from .workload import ORACLES as _WORKLOAD

ORACLES = {**_WORKLOAD, **_JOBS}
