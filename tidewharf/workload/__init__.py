"""Decision-support queries: ``WORKLOAD[key](spark, sf_dir) -> DataFrame``.

The shapes follow the published TPC-DS query set on the star-schema tables.
Three habits keep them cheap on large and uneven data:

* a fact table is summed by its join key before it meets a dimension, so a key
  that holds a third of the rows becomes one row per task before the shuffle,
  and the grouping's partitioning is the one the join needs;
* "another row of the same order ..." conditions are min/max/any per order, not
  self joins;
* no side is broadcast by hint. Catalyst broadcasts what it has measured to be
  small, and splits skewed partitions of the sort-merge joins that remain.
"""

from . import groups, joins, pivots, windows

WORKLOAD = {
    name: query
    for part in (joins, groups, windows, pivots)
    for name, query in part.QUERIES.items()
}

__all__ = ["WORKLOAD"]
