import pytest

from tidewharf.benchmark import generate, run_benchmark, save_results, summarize, table_rows
from tidewharf.session import scratch_database
from tidewharf.sources.tables import SCHEMAS


def test_generator_does_not_depend_on_parallelism(spark):
    one = generate(spark, scratch_database(spark, "gen"), scale=0.001, parallel=1)
    many = generate(spark, scratch_database(spark, "gen"), scale=0.001, parallel=7)
    for name, n in table_rows(0.001).items():
        assert one[name].schema.simpleString() == spark.createDataFrame(
            [], SCHEMAS[name]
        ).schema.simpleString()
        assert one[name].count() == n
        assert one[name].exceptAll(many[name]).isEmpty()
        assert many[name].exceptAll(one[name]).isEmpty()


def test_generated_keys_meet(spark):
    t = generate(spark, scratch_database(spark, "gen"), scale=0.001)
    lines = t["lineitem"]
    for name, key, ref in (
        ("orders", "o_orderkey", "l_orderkey"), ("part", "p_partkey", "l_partkey"),
        ("supplier", "s_suppkey", "l_suppkey"),
    ):
        assert lines.join(t[name], lines[ref] == t[name][key], "left_anti").isEmpty()


def test_runs_are_recorded(spark, tmp_path):
    def broken():
        return spark.sql("SELECT raise_error('no') AS x")

    queries = {"good": lambda: spark.range(12), "bad": broken}
    results = run_benchmark(spark, queries, iterations=2)
    got = {(r.query, r.iteration): (r.row_count, r.status) for r in results.collect()}
    assert got == {
        ("good", 1): (12, "ok"), ("good", 2): (12, "ok"),
        ("bad", 1): (None, "failed"), ("bad", 2): (None, "failed"),
    }
    save_results(results, f"{tmp_path}/r", "a")
    save_results(results, f"{tmp_path}/r", "b")
    assert spark.read.json(f"{tmp_path}/r").groupBy("run_id").count().count() == 2


def test_errors_are_kept_whole(spark):
    def fails(error):
        raise error

    queries = {"empty": lambda: fails(ValueError()), "long": lambda: fails(ValueError("a\nb"))}
    results = run_benchmark(spark, queries, iterations=1)
    assert {r.query: r.error for r in results.collect()} == {"empty": "ValueError()", "long": "a\nb"}


def test_names(spark):
    with pytest.raises(KeyError, match="missing"):
        run_benchmark(spark, {"a": lambda: spark.range(1)}, names=["missing"])


def test_summary(spark):
    data = [("a", i, 1, ms, "ok", None) for i, ms in enumerate((5, 1, 2000))]
    data += [("a", 9, None, 7, "failed", "x"), ("b", 1, 1, 10, "ok", None), ("b", 2, 1, 21, "ok", None)]
    data += [("c", 1, None, 3, "failed", "y"), ("c", 2, None, 4, "failed", "z")]
    results = spark.createDataFrame(
        data, "query string, iteration int, row_count bigint, elapsed_ms bigint, status string, error string"
    )
    got = {r.query: tuple(r)[1:] for r in summarize(results).collect()}
    assert got == {"a": (3, 1, 1, 2006 / 3, 2000, 5.0), "b": (2, 0, 10, 15.5, 21, 15.5),
                   "c": (0, 2, None, None, None, None)}
