"""The statement transcripts: databases, tables, literal rows and permissions."""

import pytest

from tidewharf.plans import Workspace, run_statement
from tidewharf.session import scratch_database_name


@pytest.fixture
def space(spark):
    name, location = scratch_database_name(spark, "space")
    workspace = Workspace(spark, name)
    workspace.create_database(location=location)
    yield workspace
    workspace.drop_database(cascade=True)


def test_default_statement_lists_databases(spark, space):
    shown = run_statement(spark)
    assert shown.columns == ["namespace"]
    assert {"default", space.database} <= {r.namespace for r in shown.collect()}


def test_table_life(spark, space, rows):
    space.create_table("test", "id int, name string")
    listed = run_statement(spark, f"show tables from {space.database};")
    assert listed.columns == ["namespace", "tableName", "isTemporary"]
    assert (space.database, "test", False) in [tuple(r) for r in listed.collect()]
    table = f"{space.database}.test"
    run_statement(spark, f"insert into {table} values (1,'alpha'),(2,'beta'),(3,'gamma'),(4,'delta')")
    assert rows(run_statement(spark, f"select * from {table}")) == [
        (1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta")
    ]


def test_duplicate_ids_are_allowed(spark, space, rows):
    space.create_table("test", "id int, name string")
    space.insert_values("test", [(1, "it's"), (1, "alpha")])
    run_statement(spark, f'insert into table {space.database}.test values (2,"spark")')
    assert set(rows(spark.table(f"{space.database}.test"))) == {
        (1, "alpha"), (1, "it's"), (2, "spark")
    }


def test_create_and_drop_database(spark, space):
    with pytest.raises(Exception, match="SCHEMA_ALREADY_EXISTS"):
        space.create_database(if_not_exists=False)
    space.create_database()
    space.create_table("test", "id int")
    with pytest.raises(Exception):
        space.drop_database()
    space.drop_database(cascade=True)
    space.drop_database()


def test_ctas_and_cvas(spark, space):
    space.create_table_as("kept", "SELECT id FROM range(4)")
    space.create_view_as("seen", f"SELECT id FROM {space.database}.kept WHERE id > 1")
    run_statement(spark, f"INSERT INTO {space.database}.kept VALUES (9)")
    assert spark.table(f"{space.database}.seen").count() == 3


def test_upload(spark, space, rows, tmp_path):
    (tmp_path / "u.csv").write_text("id;name\n1;a\n2;b\n")
    space.upload(str(tmp_path / "u.csv"), "declared", schema="id int, name string", delimiter=";")
    space.upload(str(tmp_path / "u.csv"), "inferred", delimiter=";")
    for table in ("declared", "inferred"):
        assert rows(spark.table(f"{space.database}.{table}")) == [(1, "a"), (2, "b")]


def test_permissions(spark, tmp_path):
    space = Workspace(spark, "default", allow_ctas=False, allow_cvas=False, allow_file_upload=False)
    for attempt in (
        lambda: space.create_table_as("t", "SELECT 1"),
        lambda: space.create_view_as("v", "SELECT 1"),
        lambda: space.upload(str(tmp_path), "t"),
    ):
        with pytest.raises(PermissionError):
            attempt()


def test_one_statement_at_a_time(spark):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        run_statement(spark, "select 1; select 2")


def test_uploads_fail_loudly(spark, space, rows, tmp_path):
    (tmp_path / "bad.csv").write_text("id,name\n1,a\nx,b\n")
    (tmp_path / "swapped.csv").write_text("name,id\na,1\n")
    for name in ("bad", "swapped"):
        with pytest.raises(Exception):
            space.upload(f"{tmp_path}/{name}.csv", name, schema="id int, name string")
            spark.table(f"{space.database}.{name}").collect()
    space.upload(f"{tmp_path}/bad.csv", "lenient", schema="id int, name string", mode="DROPMALFORMED")
    assert rows(spark.table(f"{space.database}.lenient")) == [(1, "a")]
