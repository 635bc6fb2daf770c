"""The entry module with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


def loaded(folder):
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return tuple(map(int, run.stdout.split()))


def test_the_rest_loads_without_the_subpackage(tmp_path):
    """Both folders deleted, with the pipeline there and without it."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    (tmp_path / "repo/corpus_pipeline.py").write_text("from penstroke.llm.common import table\n")
    with_pipeline = loaded(tmp_path / "repo")
    (tmp_path / "repo/corpus_pipeline.py").unlink()
    assert with_pipeline == loaded(tmp_path / "repo") and with_pipeline[0] > 80 and with_pipeline[1] == 0
