"""The entry module with the training-data parts taken out, with or without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["spanloom/llm", "tests/llm"], ["spanloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(os.path.basename(g) for g in gone)))
    assert not any((copy / g).exists() for g in gone)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout
