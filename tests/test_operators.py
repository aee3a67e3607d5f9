from decimal import Decimal
import random

import pytest
from pyspark.sql import functions as F

from tidewharf.functions.exact import CENTS, amount, cents, merge, partial, total
from tidewharf.operators import Rule, apply_changes, readiness, tag_rows


def test_exact_sums_do_not_depend_on_order(spark):
    pick = random.Random(5)
    prices = [pick.randrange(-10**9, 10**9) / 100 for _ in range(5000)]
    expected = float(sum(Decimal(str(p)) for p in prices))
    for tasks in (1, 7):
        df = spark.createDataFrame([(p, i % 3) for i, p in enumerate(prices)], "p double, k int")
        df = df.repartition(tasks)
        assert df.agg(total(cents("p"), CENTS)).first()[0] == expected
        by_key = df.groupBy("k").agg(*partial(cents("p"), "p"))
        assert by_key.agg(merge("p", CENTS)).first()[0] == expected
        assert sum(
            Decimal(str(r[0])) for r in by_key.select(amount("p", CENTS)).collect()
        ) == Decimal(str(expected))


def test_exact_sum_beyond_bigint(spark):
    df = spark.range(400).select(F.lit(2**62).cast("bigint").alias("units"))
    assert df.agg(total(F.col("units"), 1.0)).first()[0] == float(400 * 2**62)
    assert df.limit(0).agg(total(F.col("units"), 1.0)).first()[0] is None


def test_apply_changes(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, v string")
    changes = spark.createDataFrame(
        [(1, None, "D", 1), (2, "old", "U", 1), (2, "new", "U", 2), (3, "x", "U", 1),
         (3, None, "D", 2), (5, "e", "U", 1), (6, None, "D", 1), (4, None, "D", 3), (4, "z", "U", 3)],
        "id int, v string, op string, seq bigint",
    )
    result = apply_changes(target, changes, ["id"], "seq", "op")
    assert rows(result) == [(2, "new"), (4, "z"), (5, "e")]


def test_superseded_changes_are_dropped_before_the_shuffle(spark):
    target = spark.range(10).selectExpr("id", "id AS v")
    changes = spark.range(1000).selectExpr("id % 3 AS id", "id AS v", "'U' AS op", "id AS seq")
    plan = apply_changes(target, changes, ["id"], "seq", "op")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_readiness_counts_unknown_as_not_ready(spark, rows):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "g string, ok boolean")
    assert rows(readiness(df, ["g"], F.col("ok"))) == [
        ("a", 1, 2, False, "1/2"), ("b", 1, 1, True, "1/1"),
    ]


def test_tagging_takes_the_first_rule_of_the_whole_text(spark, rows):
    rules = [Rule(2, "timed out", "slow"), Rule(1, "refused", "down")]
    texts = [("x" * 100_000 + " timed out",), ("timed out, then refused",), ("fine",), (None,)]
    tagged = tag_rows(spark.createDataFrame(texts, "t string"), "t", rules, "unknown")
    assert [r.tag for r in tagged.collect()] == ["slow", "down", "unknown", "unknown"]
    assert "Join" not in tagged._jdf.queryExecution().toString()


def test_tagging_needs_distinct_priorities(spark):
    with pytest.raises(ValueError, match="priorities"):
        tag_rows(spark.range(1), "id", [Rule(1, "a", "x"), Rule(1, "b", "y")], "d")


def test_rules_of_a_table(spark, rows):
    texts = spark.createDataFrame([(1, "ab"), (2, "b"), (3, None)], "id int, t string")
    table = spark.createDataFrame([(2, "b", "B"), (1, "a", "A")],
                                  "priority int, pattern string, tag string")
    assert rows(tag_rows(texts, "t", table, "none").select("id", "tag")) == [
        (1, "A"), (2, "B"), (3, "none")]
    for bad in ([(1, None, "x")], [(1, "a", "x"), (1, "b", "y")]):
        with pytest.raises(ValueError):
            tag_rows(texts, "t", spark.createDataFrame(bad, table.schema), "none")
