"""Every query against its SQL, over whole small tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from marlstone.plans.registry import oracle_sql, queries

from .compare import difference

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    assert difference(spark, FOLDER, queries()[name], oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 5 and "close_10_ema" in df.columns
    assert set(queries()) <= set(__spark_entry__.queries()) and set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_without_the_corpus_subpackage(tmp_path):
    """The entry point works on a copy that lacks it, whether the pipeline's file is still there or not."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for pipeline in (True, False):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        elif not pipeline:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert run.stdout.split() == [str(len(queries())), str(len(oracle_sql()))], run.stderr
