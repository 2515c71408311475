"""The entry without the training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_imports_without_the_training_part(tmp_path, with_pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)
