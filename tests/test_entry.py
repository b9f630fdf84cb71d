"""The driver's entry points with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["tidemark/llm", "tests/llm", "corpus_pipeline.py"], ["tidemark/llm", "tests/llm"]])
def test_queries_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in map(copy.joinpath, gone):
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
