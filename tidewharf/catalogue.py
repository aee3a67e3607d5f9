"""Every registered query: name -> callable(spark, sf_dir).

The workload queries come as they are. The rest drive a source, a sink, a
statement or the benchmark over the given tables and return what can be read
back, so that the result shows whether the operation did its work.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import benchmark
from .functions.exact import CENTS, cents, total
from .operators import Rule, tag_rows
from .plans import (
    FileSink, JdbcSource, Job, ParquetSource, SqlTransform, TableSink, Workspace, run_statement,
    sql_transform,
)
from .session import at_clearing, scratch_database, scratch_database_name, scratch_dir
from .sinks import (
    Database, file_sink, jdbc_sink, latest_run, load_once, merge_changes, published_runs,
    read_directories, read_run, table_sink,
)
from .sinks.publish import filesystem
from .sources import jdbc_source, load
from .sources.tables import SCHEMAS
from .workload import WORKLOAD

QUERIES = {**WORKLOAD}


def registered(function):
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


# --- JDBC sources ---------------------------------------------------------------

JDBC_SETTINGS = ("url", "driver", "user", "password")


def _database_copy(
    spark: SparkSession, sf_dir: str, name: str = "orders",
    column_types: str = "o_orderstatus VARCHAR(8), o_orderpriority VARCHAR(32)",
) -> dict:
    """Connection to a database holding a fresh copy of a table, and that copy's name.

    A cluster names a database that its executors can reach in
    ``spark.tidewharf.jdbc.url`` (and ``.driver``, ``.user``, ``.password``). A
    local session may do without: it gets an in-memory Derby database, which only
    its own process sees.
    """
    given = {s: spark.conf.get(f"spark.tidewharf.jdbc.{s}", None) for s in JDBC_SETTINGS}
    if not given["url"]:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.tidewharf.jdbc.url to a database the executors can reach")
        memory = scratch_dir(spark, name).rsplit("/", 1)[1]
        given.update(
            url=f"jdbc:derby:memory:{memory};create=true",
            driver="org.apache.derby.jdbc.EmbeddedDriver",
        )
    table = f"{name}_" + scratch_dir(spark, "copy").rsplit("-", 1)[1]
    connection = {key: value for key, value in given.items() if value}
    jdbc_sink(
        load(spark, sf_dir, name), table=table, data_mode="error_if_exists",
        max_connections=8, column_types=column_types,
        **connection,
    )
    database = Database(spark, connection["url"], connection["driver"], connection.get("user"),
                        connection.get("password"))
    at_clearing(spark, lambda: database.run(f"DROP TABLE {table}"))
    return {**connection, "table": table}


@registered
def jdbc_query_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query the database answers itself: orders per status and priority."""
    connection = _database_copy(spark, sf_dir)
    table = connection.pop("table")
    return jdbc_source(
        spark,
        query=f'SELECT "o_orderstatus", "o_orderpriority", COUNT(*) AS "n_orders",'
        f' MAX("o_orderdate") AS "last_order" FROM {table}'
        ' GROUP BY "o_orderstatus", "o_orderpriority"',
        **connection,
    ).withColumn("n_orders", F.col("n_orders").cast("bigint"))


@registered
def jdbc_partitioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, read in four ranges of the customer key."""
    connection = _database_copy(spark, sf_dir)
    table = connection.pop("table")
    return jdbc_source(
        spark, query=f"SELECT * FROM {table}", fetch_size=10_000, partition_column="o_custkey",
        partition_num=4, spread_column="o_orderkey", **connection,
    )


@registered
def jdbc_text_partitioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, read in eight ranges of segment and name, a text that the query makes."""
    connection = _database_copy(
        spark, sf_dir, "customer", "c_name VARCHAR(64), c_mktsegment VARCHAR(32)")
    table = connection.pop("table")
    return jdbc_source(
        spark, query=f'SELECT t.*, "c_mktsegment" || \'/\' || "c_name" AS "path" FROM {table} t',
        partition_column="path", partition_num=8, spread_column="c_custkey", **connection,
    )


# --- Transforms and jobs --------------------------------------------------------

_MONTHLY = """
    SELECT o_orderpriority, CAST(month(o_orderdate) AS BIGINT) AS order_month,
           count(*) AS n_orders
    FROM {table} GROUP BY ALL"""


@registered
def sql_transform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and month, through two named views."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("transform_input")
    sql_transform(
        spark, "transform_input", "transform_output", _MONTHLY.format(table="transform_input")
    )
    return spark.table("transform_output")


@registered
def job_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers from Parquet, two transforms, delimited files, read back."""
    path = scratch_dir(spark, "job")
    job = Job(
        env={"job.mode": "BATCH"},
        source={
            "job_orders": ParquetSource(f"{sf_dir}/orders.parquet", SCHEMAS["orders"]),
            "job_customers": ParquetSource(f"{sf_dir}/customer.parquet", SCHEMAS["customer"]),
        },
        transform={
            "count": SqlTransform(
                "job_orders", "job_counts",
                "SELECT o_custkey, count(*) AS n_orders FROM job_orders GROUP BY o_custkey",
            ),
            "label": SqlTransform(
                "job_counts", "job_segments",
                "SELECT c_mktsegment, c_nationkey, sum(n_orders) AS n_orders FROM job_counts"
                " JOIN job_customers ON o_custkey = c_custkey GROUP BY c_mktsegment, c_nationkey",
            ),
        },
        sink={"files": FileSink(path, {"fmt": "text"})},
    )
    written = job.run(spark)["files"]
    return spark.read.schema("c_mktsegment string, c_nationkey int, n_orders bigint").csv(written)


@registered
def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named run whose second of three sinks fails, run again: what each sink holds in the end."""
    connection, path = _database_copy(spark, sf_dir), scratch_dir(spark, "resumed")
    table, url, driver = (connection.pop(key) for key in ("table", "url", "driver"))
    db = scratch_database(spark, "resumed")
    file_sink(load(spark, sf_dir, "orders").limit(0), f"{path}/second", "parquet")  # in the way
    job = Job(
        source={"resumed_orders": JdbcSource(url, f"SELECT * FROM {table}", driver, connection)},
        sink={
            "first": TableSink(f"{db}.orders", label="run", ledger=f"{db}.ledger"),
            "second": FileSink(f"{path}/second", {"fmt": "parquet"}),
            "third": FileSink(f"{path}/third", {"fmt": "parquet", "listed": True, "mode": "append"}),
        },
    )
    run_id = path.rsplit("-", 1)[1]
    try:
        job.run(spark, run_id)
        outcome = "finished"
    except AnalysisException:  # the path is taken
        outcome = "stopped"
    filesystem(spark, path)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/second"), True)
    for _ in range(2):
        job.run(spark, run_id)
    held = {
        "first": spark.table(f"{db}.orders").drop("load_label"),
        "second": spark.read.schema(SCHEMAS["orders"]).parquet(f"{path}/second"),
        "third": read_run(spark, f"{path}/third"),
    }
    result = None
    for name, rows in held.items():
        part = rows.select(F.lit(name).alias("sink"), F.lit(outcome).alias("at_first"), *rows.columns)
        result = part if result is None else result.unionByName(part)
    return result


# --- File sinks -----------------------------------------------------------------


@registered
def file_sink_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_sink(load(spark, sf_dir, "orders"), scratch_dir(spark, "delimited"), "text")
    return spark.read.schema(SCHEMAS["orders"]).option("sep", ",").option("lineSep", "\n").csv(path)


@registered
def file_sink_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written in each format; every copy is read back and named."""
    suppliers = load(spark, sf_dir, "supplier")
    copies = []
    for fmt in ("csv", "json", "orc", "parquet", "xml"):
        path = file_sink(suppliers, scratch_dir(spark, fmt), fmt)
        reader = spark.read.schema(SCHEMAS["supplier"]).format(fmt)
        if fmt == "xml":
            reader = reader.option("rowTag", "row")
        copies.append(reader.load(path).withColumn("format", F.lit(fmt)))
    result = copies[0]
    for copy in copies[1:]:
        result = result.unionByName(copy)
    return result


@registered
def file_sink_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as gzip text and zstd Parquet."""
    customers = load(spark, sf_dir, "customer")
    text = file_sink(customers, scratch_dir(spark, "gzip"), "csv", codec="gzip")
    columnar = file_sink(customers, scratch_dir(spark, "zstd"), "parquet", codec="zstd")
    return (
        spark.read.schema(SCHEMAS["customer"]).csv(text).withColumn("codec", F.lit("gzip"))
        .unionByName(
            spark.read.schema(SCHEMAS["customer"]).parquet(columnar)
            .withColumn("codec", F.lit("zstd"))
        )
    )


@registered
def file_sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a directory per status and priority, the columns kept in the files."""
    path = file_sink(
        load(spark, sf_dir, "orders"), scratch_dir(spark, "partitioned"), "parquet",
        partition_by=["o_orderstatus", "o_orderpriority"], keep_partition_columns=True,
    )
    return spark.read.schema(
        f"{SCHEMAS['orders']}, by_o_orderstatus string, by_o_orderpriority string"
    ).parquet(path)


@registered
def file_sink_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in directories by an expression over year, month, status and priority, read back."""
    template = "year=${year},month=${month}/${o_orderstatus}/${o_orderpriority}"
    path = file_sink(
        load(spark, sf_dir, "orders"), scratch_dir(spark, "directories"), "parquet", directory=template,
        directory_columns={"year": "year(o_orderdate)", "month": "month(o_orderdate)"},
    )
    left = ", ".join(c for c in SCHEMAS["orders"].split(", ")
                     if c.split()[0] not in ("o_orderstatus", "o_orderpriority"))
    return read_directories(
        spark, path, template, left, types={"year": "bigint", "month": "bigint"})


@registered
def file_sink_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_sink(
        load(spark, sf_dir, "lineitem"), scratch_dir(spark, "columns"), "csv",
        columns=["l_shipdate", "l_orderkey", "l_returnflag"],
    )
    return spark.read.schema(
        "l_shipdate timestamp_ntz, l_orderkey bigint, l_returnflag string"
    ).csv(path)


@registered
def file_sink_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files of at most 5,000 rows: how many rows, and does every file obey."""
    limit = 5_000
    path = file_sink(
        load(spark, sf_dir, "lineitem"), scratch_dir(spark, "batch"), "parquet",
        max_rows_per_file=limit,
    )
    per_file = (
        spark.read.schema(SCHEMAS["lineitem"]).parquet(path)
        .groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    )
    return per_file.agg(
        F.sum("n").alias("n_lines"),
        (F.max("n") <= limit).alias("files_within_limit"),
        (F.count(F.lit(1)) >= F.ceil(F.sum("n") / limit)).alias("enough_files"),
    )


@registered
def file_sink_run_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stamped runs side by side, and which of them is the latest."""
    orders, path = load(spark, sf_dir, "orders"), scratch_dir(spark, "stamped")
    for day, batch in ((1, "o_orderstatus = 'F'"), (2, "not o_orderstatus <=> 'F'")):
        file_sink(
            orders.where(batch), path, "parquet", run_stamp="%Y%m%d%H%M%S",
            now=datetime(2024, 1, day),
        )
    newest = latest_run(spark, path).rsplit("=", 1)[1]
    return (
        spark.read.schema(f"{SCHEMAS['orders']}, run string").parquet(path)
        .groupBy("run", "o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n_orders"), total(cents("o_totalprice"), CENTS).alias("price")
        )
        .withColumn("latest", F.col("run") == newest)
    )


@registered
def file_sink_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged write that replaces an earlier one."""
    orders, path = load(spark, sf_dir, "orders"), scratch_dir(spark, "staged")
    options = {"fmt": "parquet", "tmp_path": scratch_dir(spark, "tmp"), "transaction": True}
    file_sink(orders.where("o_orderstatus = 'F'"), path, **options)
    file_sink(orders, path, mode="overwrite", **options)
    return spark.read.schema(SCHEMAS["orders"]).parquet(path)


@registered
def file_sink_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs published by lists of files: a first, one appended, one that dies, one refused."""
    orders, path = load(spark, sf_dir, "orders"), scratch_dir(spark, "listed")
    options = {"fmt": "parquet", "listed": True, "partition_by": ["o_orderstatus"]}
    file_sink(orders.where("o_orderstatus = 'F'"), path, **options)
    file_sink(orders.where("not o_orderstatus <=> 'F'"), path, mode="append", **options)
    broken = orders.withColumn("o_totalprice", F.expr(
        "o_totalprice + if(o_orderkey is null, 0, raise_error('stopped'))"))
    outcomes = []
    for batch, mode in ((broken, "overwrite"), (orders, "errorifexists")):
        try:
            file_sink(batch, path, mode=mode, **options)
            outcomes.append("accepted")
        except FileExistsError:
            outcomes.append("refused")
        except Exception:  # the stopped job's, whatever wraps it
            outcomes.append("stopped")
    return read_run(spark, path).withColumns({
        "outcomes": F.lit(", ".join(outcomes)),
        "n_runs": F.lit(len(published_runs(spark, path))).cast("bigint")})


STATUSES = ("F", "O", "P")


def _by_status(orders: DataFrame) -> list[tuple[str, DataFrame]]:
    """Orders of each known status, and last all of any other status or none."""
    known = F.coalesce(F.col("o_orderstatus").isin(*STATUSES), F.lit(False))
    parts = [(s, orders.where(F.col("o_orderstatus") == s)) for s in STATUSES]
    return [*parts, ("other", orders.where(~known))]


# --- Table sinks ----------------------------------------------------------------


@registered
def table_sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended status by status, then all of any other status or none."""
    table = f"{scratch_database(spark, 'append')}.orders"
    orders = load(spark, sf_dir, "orders")
    for _, batch in _by_status(orders):
        table_sink(batch, table)
    return spark.table(table)


@registered
def table_sink_data_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each data mode leaves in a table that held the 'F' orders."""
    db, orders = scratch_database(spark, "modes"), load(spark, sf_dir, "orders")
    left = []
    for mode in ("append", "overwrite", "error_if_data", "ignore_if_data"):
        table = f"{db}.orders_{mode}"
        table_sink(orders.where("o_orderstatus = 'F'"), table)
        try:
            table_sink(orders.where("not o_orderstatus <=> 'F'"), table, data_mode=mode)
            outcome = "accepted"
        except ValueError:
            outcome = "refused"
        left.append(
            spark.table(table).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))
            .withColumns({"data_mode": F.lit(mode), "outcome": F.lit(outcome)})
        )
    return left[0].unionByName(left[1]).unionByName(left[2]).unionByName(left[3])


@registered
def table_sink_schema_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each schema mode does with a missing and with a present table."""
    db, orders = scratch_database(spark, "schemas"), load(spark, sf_dir, "orders")
    wide, narrow = orders, orders.select("o_orderkey", "o_orderstatus")
    left = []
    for mode in ("create_if_missing", "recreate", "fail_if_missing"):
        table = f"{db}.orders_{mode}"
        try:
            table_sink(wide, table, schema_mode=mode)
            first = "created"
        except LookupError:
            first = "refused"
            table_sink(wide, table)
        again = narrow if mode == "recreate" else wide
        table_sink(again, table, schema_mode=mode)
        left.append(
            spark.table(table).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))
            .withColumns({
                "schema_mode": F.lit(mode),
                "when_missing": F.lit(first),
                "n_columns": F.lit(len(spark.table(table).columns)).cast("bigint"),
            })
        )
    return left[0].unionByName(left[1]).unionByName(left[2])


@registered
def table_sink_cast_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stored as JSON text, their elements counted after parsing back."""
    table = f"{scratch_database(spark, 'casts')}.embeddings"
    table_sink(load(spark, sf_dir, "embeddings"), table, cast_unsupported=True)
    numbers = F.from_json("embedding", "array<float>")
    return spark.table(table).select(
        "vec_id", "label", F.size(numbers).cast("bigint").alias("n_elements")
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes drawn from orders: 'F' deleted, 'P' repriced twice, 'O' copied as new
    orders, of which the urgent ones are taken back."""
    orders = load(spark, sf_dir, "orders")
    price, copied = F.col("o_totalprice"), (-F.col("o_orderkey") - 1).alias("o_orderkey")
    others = [c for c in orders.columns if c != "o_orderkey"]
    fresh = orders.where("o_orderstatus = 'O'").select(copied, *others)
    repriced = orders.where("o_orderstatus = 'P'")

    def change(df: DataFrame, op: str, seq: int) -> DataFrame:
        return df.withColumns({"op": F.lit(op), "seq": F.lit(seq).cast("bigint")})

    return (
        change(orders.where("o_orderstatus = 'F'"), "D", 1)
        .unionByName(change(repriced.withColumn("o_totalprice", price + 1), "U", 1))
        .unionByName(change(repriced.withColumn("o_totalprice", price + 2), "U", 2))
        .unionByName(change(fresh, "U", 1))
        .unionByName(change(fresh.where("o_orderpriority = '1-URGENT'"), "D", 2))
    )


@registered
def table_sink_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes merged into a partitioned table: only the partitions concerned are rewritten."""
    table = f"{scratch_database(spark, 'changes')}.orders"
    table_sink(load(spark, sf_dir, "orders"), table, partition_by=["o_orderstatus"])
    merge_changes(table, order_changes(spark, sf_dir), ["o_orderkey"], "seq", "op")
    return spark.table(table)


@registered
def table_sink_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelled batches, the first delivered twice, beside their ledger entries."""
    db, orders = scratch_database(spark, "labels"), load(spark, sf_dir, "orders")
    finished = orders.where("o_orderstatus = 'F'")
    for label, batch in (("done", finished), ("done", finished),
                         ("open", orders.where("not o_orderstatus <=> 'F'"))):
        load_once(batch, f"{db}.orders", label, f"{db}.ledger")
    entries = spark.table(f"{db}.ledger").select("label", F.col("row_count").alias("ledger_rows"))
    return (
        spark.table(f"{db}.orders")
        .groupBy(F.col("load_label").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"), total(cents("o_totalprice"), CENTS).alias("price")
        )
        .join(entries, "label")
    )


@registered
def table_sink_custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncate, then append: the earlier rows are gone."""
    table = f"{scratch_database(spark, 'custom')}.orders"
    orders = load(spark, sf_dir, "orders")
    table_sink(orders, table)
    table_sink(orders.where("o_orderstatus = 'P'"), table, pre_sql="TRUNCATE TABLE {table}")
    return spark.table(table)


# --- Statements -----------------------------------------------------------------


def _status_databases(spark: SparkSession, sf_dir: str) -> dict[str, Workspace]:
    """One database per known order status with its orders, and one for all others."""
    spaces = {}
    others = "NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)"
    conditions = {status: f"o_orderstatus = '{status}'" for status in STATUSES} | {"other": others}
    for status, condition in conditions.items():
        space = Workspace(spark, scratch_database(spark, f"status_{status.lower()}"))
        space.create_table_as(
            "orders", f"SELECT * FROM parquet.`{sf_dir}/orders.parquet` WHERE {condition}"
        )
        spaces[status] = space
    return spaces


def _listed(spark: SparkSession, spaces: dict[str, Workspace]) -> DataFrame:
    """The databases that SHOW DATABASES lists, with their orders counted by status."""
    shown = {row["namespace"] for row in run_statement(spark).collect()}
    counts = spark.createDataFrame([], "status string, n_orders bigint")
    for space in spaces.values():
        if space.database in shown:
            counts = counts.unionByName(
                spark.table(f"{space.database}.orders")
                .groupBy(F.col("o_orderstatus").alias("status"))
                .agg(F.count(F.lit(1)).alias("n_orders"))
            )
    return counts


@registered
def sql_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statement(
        spark,
        f"""SELECT o_orderstatus, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
            FROM parquet.`{sf_dir}/orders.parquet` GROUP BY o_orderstatus;""",
    )


@registered
def sql_show_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, _status_databases(spark, sf_dir))


@registered
def sql_drop_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = _status_databases(spark, sf_dir)
    spaces["P"].drop_database(cascade=True)
    return _listed(spark, spaces)


@registered
def sql_create_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creating twice is harmless with IF NOT EXISTS; the tables in it stay."""
    name, location = scratch_database_name(spark, "created")
    space = Workspace(spark, name)
    space.create_database(if_not_exists=False, location=location)
    space.create_table_as("customer", f"SELECT * FROM parquet.`{sf_dir}/customer.parquet`")
    space.create_database()
    return spark.table(f"{space.database}.customer")


@registered
def sql_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch_database(spark, "typed"))
    space.create_table("supplier", "id BIGINT, name STRING, balance DOUBLE")
    run_statement(
        spark,
        f"INSERT INTO {space.database}.supplier SELECT s_suppkey, s_name, s_acctbal"
        f" FROM parquet.`{sf_dir}/supplier.parquet`",
    )
    return spark.table(f"{space.database}.supplier")


@registered
def sql_show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a database as listed, with the lines in each: one per known flag, one for
    all other lines."""
    space = Workspace(spark, scratch_database(spark, "tables"))
    conditions = {flag.lower(): f"l_returnflag = '{flag}'" for flag in "ANR"}
    conditions["other"] = "NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)"
    for name, condition in conditions.items():
        space.create_table_as(
            f"lines_{name}",
            f"SELECT l_orderkey FROM parquet.`{sf_dir}/lineitem.parquet` WHERE {condition}",
        )
    counts = None
    for row in space.show_tables().where("not isTemporary").collect():
        count = spark.table(f"{row['namespace']}.{row['tableName']}").agg(
            F.lit(row["tableName"]).alias("tableName"),
            F.lit(row["isTemporary"]).alias("isTemporary"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        counts = count if counts is None else counts.unionByName(count)
    return counts


@registered
def sql_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted literals, joined with the customers they describe."""
    space = Workspace(spark, scratch_database(spark, "values"))
    space.create_table("targets", "segment STRING, target BIGINT")
    space.insert_values("targets", [("BUILDING", 10), ("MACHINERY", 20)])
    run_statement(spark, f"INSERT INTO TABLE {space.database}.targets VALUES ('FURNITURE', 30)")
    run_statement(spark, f"INSERT INTO {space.database}.targets VALUES ('FURNITURE', 40)")
    customers = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_customers")
    )
    return spark.table(f"{space.database}.targets").join(
        customers, F.col("segment") == F.col("c_mktsegment")
    ).select("segment", "target", "n_customers")


@registered
def sql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch_database(spark, "selects"))
    space.create_table_as("part", f"SELECT * FROM parquet.`{sf_dir}/part.parquet`")
    return run_statement(
        spark, f"SELECT p_partkey, p_name FROM {space.database}.part WHERE p_size <= :size",
        {"size": 10},
    )


@registered
def sql_ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch_database(spark, "ctas"))
    space.create_table_as(
        "flags",
        "SELECT l_returnflag, l_linestatus, count(*) AS n_lines"
        f" FROM parquet.`{sf_dir}/lineitem.parquet` GROUP BY l_returnflag, l_linestatus",
    )
    return spark.table(f"{space.database}.flags")


@registered
def sql_cvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, scratch_database(spark, "cvas"))
    space.create_view_as(
        "event_counts",
        "SELECT event_type, count(*) AS n_events, max(ts) AS last_seen"
        f" FROM parquet.`{sf_dir}/events.parquet` GROUP BY event_type",
    )
    return spark.table(f"{space.database}.event_counts")


@registered
def file_upload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a delimited file, uploaded as a table."""
    path = file_sink(
        load(spark, sf_dir, "customer"), scratch_dir(spark, "upload"), "csv",
        field_delimiter=";", header=True,
    )
    space = Workspace(spark, scratch_database(spark, "uploads"))
    space.upload(path, "customer", schema=SCHEMAS["customer"], delimiter=";")
    return spark.table(f"{space.database}.customer")


# --- Generator and benchmark ----------------------------------------------------


def _benched(spark: SparkSession, sf_dir: str) -> dict:
    return {name: lambda name=name: WORKLOAD[name](spark, sf_dir) for name in WORKLOAD}


@registered
def bench_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole workload, twice."""
    results = benchmark.run_benchmark(spark, _benched(spark, sf_dir), iterations=2)
    return results.select("query", F.col("iteration").cast("bigint"), "row_count", "status")


@registered
def bench_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = benchmark.run_benchmark(
        spark, _benched(spark, sf_dir), iterations=2, names=["year_over_year", "cube_counts"]
    )
    return results.select("query", F.col("iteration").cast("bigint"), "row_count")


@registered
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events summarized as if each were a run: its type the query, its value the time."""
    runs = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"),
        cents("value").alias("elapsed_ms"),
        F.lit("ok").alias("status"),
    )
    return benchmark.summarize(runs)


@registered
def bench_results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries run twice; both runs are found under the results directory."""
    path = scratch_dir(spark, "results")
    for run_id in ("first", "second"):
        results = benchmark.run_benchmark(
            spark, _benched(spark, sf_dir), iterations=1, names=["year_over_year", "count_between"]
        )
        benchmark.save_results(results, path, run_id)
    return spark.read.schema(f"{benchmark.runner.RESULT_SCHEMA}, run_id string").json(path).select(
        "run_id", "query", "row_count"
    )


# --- Tagging --------------------------------------------------------------------

RULES = (
    Rule(1, "license", "licence text"),
    Rule(2, "@", "contact"),
    Rule(3, " | ", "table"),
    Rule(4, "the ", "prose"),
)


@registered
def rule_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the tag of the first rule found in its whole text."""
    return tag_rows(load(spark, sf_dir, "documents"), "text", RULES, "untagged").select(
        "doc_id", "tag"
    )


@registered
def rule_table_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first word of the benchmark texts that its whole text holds.

    The rules are a table: every word of three letters or more, by where it stands first.
    """
    words = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(
        F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("at", "pattern"))
    rules = words.groupBy("pattern").agg(
        F.min(F.col("item_id") * 1_000_000 + F.col("at")).alias("priority"),
        F.concat(F.lit("item "), F.min("item_id").cast("string")).alias("tag"))
    return tag_rows(load(spark, sf_dir, "documents"), "text", rules, "none").select("doc_id", "tag")
