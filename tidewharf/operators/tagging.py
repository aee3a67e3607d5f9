"""Tag texts with the first rule whose phrase they contain."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .rule_index import tag_by_table


class Rule(NamedTuple):
    priority: int
    pattern: str
    tag: str


def tag_rows(
    df: DataFrame, text: str, rules: Sequence[Rule] | DataFrame, default: str, *, name: str = "tag"
) -> DataFrame:
    """Add the tag of the lowest-priority-number rule found in ``text``.

    A list of rules is written by hand and short, so it becomes one CASE expression: the
    texts are read once where they lie, without a join or a shuffle. A table of rules, of any
    length, is indexed (``tag_by_table``). Two rules may not share a priority, or the result
    would depend on their order.
    """
    if isinstance(rules, DataFrame):
        return tag_by_table(df, text, rules, default, name=name)
    if len({rule.priority for rule in rules}) != len(rules):
        raise ValueError("rule priorities must differ")
    tag: Column = F.lit(default)
    for rule in sorted(rules, reverse=True):
        tag = F.when(F.contains(F.col(text), F.lit(rule.pattern)), F.lit(rule.tag)).otherwise(tag)
    return df.withColumn(name, tag)
