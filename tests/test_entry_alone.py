"""The entry point on a copy of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT
from tidewharf.catalogue import QUERIES

COUNT = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), *sorted(e.queries()))"


def loaded(folder, before=""):
    out = subprocess.run([sys.executable, "-c", f"{before}\n{COUNT}"], cwd=folder, check=True,
                         capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    return out.stdout.split()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_folders(tmp_path, gone):
    for name in ("tidewharf", "oracles"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name,
                        ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    assert loaded(tmp_path) == ["True", *sorted(QUERIES)]


def test_without_the_vocabularies():
    got = loaded(ROOT, "import sys; sys.modules['public_tokenizers'] = None")
    assert got == ["True", *sorted(QUERIES)]
