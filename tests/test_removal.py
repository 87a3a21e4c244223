"""The repository without the pipeline operators: everything else imports, is collected and runs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ONE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not [q for q in entry.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
assert set(entry.oracle_sql()) <= set(entry.queries())
assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_pipeline_operators(tmp_path, sf_dir, pipeline):
    skipped = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=skipped)
    env = os.environ | {"PYTHONPATH": str(copy)}
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout[-2000:]
    if pipeline:
        ran = subprocess.run([sys.executable, "-c", ONE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert ran.returncode == 0, ran.stderr[-2000:]
