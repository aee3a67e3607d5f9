import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidewharf.session import CHECKPOINT_DIR, local_session, scratch_database  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8,
        "tests",
        **{
            CHECKPOINT_DIR: str(tmp_path_factory.mktemp("scratch")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def db(spark):
    return scratch_database(spark, "test")


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows():
    """Sorted plain tuples of a result."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
