import uuid

import pytest

from tidewharf.plans import FileSink, JdbcSource, Job, ParquetSource, SqlTransform, TableSink
from tidewharf.sinks import jdbc_sink


@pytest.fixture
def numbers(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    return ParquetSource(f"{tmp_path}/in", "id bigint")


def test_empty_transform_is_identity(spark, numbers, tmp_path, rows):
    out = Job(source={"n1": numbers}, sink={"f": FileSink(f"{tmp_path}/out")}).run(spark)
    assert rows(spark.read.schema("id bigint").csv(out["f"])) == [(i,) for i in range(10)]


def test_two_sinks_and_a_named_input(spark, numbers, tmp_path, db):
    job = Job(
        source={"n2": numbers},
        transform={"t": SqlTransform("n2", "big", "SELECT id FROM n2 WHERE id > 6")},
        sink={"f": FileSink(f"{tmp_path}/out", {"fmt": "parquet"}),
              "t": TableSink(f"{db}.all_numbers", source_table="n2")},
        env={"parallelism": "3"},
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    job.run(spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert spark.table(f"{db}.all_numbers").count() == 10
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_database_is_read_once_for_two_sinks(spark, tmp_path, rows):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    jdbc_sink(spark.range(50), url, "t", driver=driver)
    source = JdbcSource(url, "SELECT * FROM t", driver, {"partition_column": "id"})
    sinks = {n: FileSink(f"{tmp_path}/{n}", {"fmt": "parquet"}) for n in ("a", "b")}
    Job(source={"n4": source}, sink=sinks, env={"parallelism": "3"}).run(spark)
    jdbc_sink(spark.range(7), url, "t", driver=driver)
    assert spark.table("n4").count() == 50
    assert rows(spark.read.parquet(f"{tmp_path}/a")) == rows(spark.read.parquet(f"{tmp_path}/b"))


def test_bad_jobs(spark, numbers, tmp_path):
    sink = {"f": FileSink(f"{tmp_path}/out")}
    with pytest.raises(ValueError, match="BATCH"):
        Job(source={"n3": numbers}, sink=sink, env={"job.mode": "STREAMING"}).run(spark)
    with pytest.raises(ValueError, match="submit"):
        Job(source={"n3": numbers}, sink=sink, env={"spark.driver.memory": "1g"}).run(spark)
    with pytest.raises(ValueError, match="source"):
        Job(source={}, sink=sink).run(spark)
    with pytest.raises(ValueError, match="several sources"):
        Job(source={"a3": numbers, "b3": numbers}, sink=sink).run(spark)
    with pytest.raises(LookupError):
        Job(source={"n3": numbers}, sink=sink,
            transform={"t": SqlTransform("nowhere", "r", "SELECT 1")}).run(spark)


def test_a_job_fills_a_database_and_labelled_tables(spark, numbers, db, rows):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    spec = {
        "source": {"n5": {"kind": "parquet", "path": numbers.path, "schema": "id bigint"}},
        "sink": {
            "d": {"kind": "jdbc", "url": url, "table": "t", "options": {"label": "run-1"},
                  "driver": "org.apache.derby.jdbc.EmbeddedDriver"},
            "l": {"kind": "table", "table": f"{db}.loaded", "label": "run-1", "ledger": f"{db}.g"},
        },
    }
    assert Job.from_spec(spec).run(spark) == {"d": True, "l": True}
    assert Job.from_spec(spec).run(spark) == {"d": False, "l": False}
    assert spark.table(f"{db}.loaded").count() == 10
    source = JdbcSource(url, "SELECT * FROM t", "org.apache.derby.jdbc.EmbeddedDriver")
    spark.sql(f"CREATE TABLE {db}.c (id BIGINT) USING parquet")
    Job(source={"n6": source}, sink={"c": TableSink(f"{db}.c")}).run(spark)
    changes = SqlTransform("n7", "ch", "SELECT id, 1 AS seq, if(id < 4, 'D', 'U') AS op FROM n7")
    Job(source={"n7": numbers}, transform={"t": changes}, sink={"c": TableSink(
        f"{db}.c", changes={"keys": ["id"], "seq": "seq", "op": "op"})}).run(spark)
    assert rows(spark.table(f"{db}.c")) == [(i,) for i in range(4, 10)]
