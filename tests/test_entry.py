"""The list of queries without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOAD = "import __spark_entry__ as e; q = e.queries(); assert 'exp_dt' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"


@pytest.mark.parametrize("left", ["nothing", "empty folder"])
def test_other_queries_load_alone(tmp_path, left):
    shutil.copytree(f"{ROOT}/weirline", tmp_path / "weirline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "weirline" / "llm").mkdir()
    done = subprocess.run([sys.executable, "-c", LOAD], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
