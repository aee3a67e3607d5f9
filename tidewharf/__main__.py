"""Command line: ``spark-submit``-able, or ``python -m tidewharf`` on one machine.

    sql        run one statement and print its rows
    etl        run the job described in a JSON file
    generate   write the star schema into a database
    benchmark  time the workload on a database and keep the results
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .benchmark import generate, run_benchmark, save_results, summarize
from .plans import Job, run_statement
from .session import clear_scratch
from .sources.tables import DATABASE
from .workload import WORKLOAD


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidewharf")
    commands = parser.add_subparsers(dest="command", required=True)

    sql = commands.add_parser("sql")
    sql.add_argument("-s", "--statement", default="show databases")

    etl = commands.add_parser("etl")
    etl.add_argument("job", help="JSON file with env, source, transform and sink")
    etl.add_argument("--run", help="name of this run; after a failure it goes on where it stopped")

    gen = commands.add_parser("generate")
    gen.add_argument("-d", "--database", default="default")
    gen.add_argument("-s", "--scale", type=float, default=1)
    gen.add_argument("-p", "--parallel", type=int, help="tasks per table; default 2 * scale")

    bench = commands.add_parser("benchmark")
    bench.add_argument("-d", "--database", default="default")
    bench.add_argument("-i", "--iterations", type=int, default=3)
    bench.add_argument("-q", "--queries", help="names separated by commas; default all")
    bench.add_argument("-r", "--results-dir")
    return parser


def _print(df: DataFrame) -> None:
    """All rows, tab-separated, fetched one partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join(str(value) for value in row))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidewharf").getOrCreate()
    if args.command == "sql":
        _print(run_statement(spark, args.statement))
    elif args.command == "etl":
        with open(args.job, encoding="utf-8") as file:
            written = Job.from_spec(json.load(file)).run(spark, args.run)
        for name, result in written.items():
            print(f"{name}\t{result}")
        clear_scratch(spark)
    elif args.command == "generate":
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{args.database}`")
        generate(spark, args.database, args.scale, args.parallel)
    else:
        queries = {
            name: partial(query, spark, f"{DATABASE}{args.database}")
            for name, query in WORKLOAD.items()
        }
        names = args.queries.split(",") if args.queries else None
        results = run_benchmark(spark, queries, args.iterations, names)
        if args.results_dir:
            run_id = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
            save_results(results, args.results_dir, run_id)
        _print(summarize(results).orderBy("query"))


if __name__ == "__main__":
    main()
