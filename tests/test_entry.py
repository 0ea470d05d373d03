import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_operators_for_training_data(tmp_path, pipeline):
    for name in ("personae", "checks"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    got = subprocess.run(
        [sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120,
        env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)},
    )
    assert got.returncode == 0, got.stderr
    assert min(map(int, got.stdout.split())) > 80
