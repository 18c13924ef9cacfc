"""The entry without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_text_operators(tmp_path, with_pipeline):
    at = tmp_path / "copy"
    shutil.copytree(ROOT / "swathe", at / "swathe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        shutil.copy(ROOT / name, at / name)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) > 150 and "pipeline" not in e.queries() and not any(k.startswith("op1") for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).columns == ["id", "x", "y", "z", "source"]
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
