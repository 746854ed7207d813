"""The guard around the corpus operators: silent where they were taken out, a warning for anything else."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import warnings; warnings.simplefilter('always'); import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"


def ask(root):
    got = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=root, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    n, some = got.stdout.split()
    return int(n), some == "True", "corpus operators cannot be imported" in got.stderr


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def test_taken_out(copy):
    shutil.rmtree(copy / "quillmill/llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    n, some, warned = ask(copy)
    assert n > 200 and not some and not warned


@pytest.mark.parametrize("text", ["1 / 0", "from quillmill.llm.common import no_such_name", "import quillmill.llm.no_such_module"])
def test_broken(copy, text):
    (copy / "quillmill/llm").mkdir(exist_ok=True)
    for name in ("__init__.py", "registry.py"):
        (copy / "quillmill/llm" / name).write_text(text if name == "registry.py" else "")
    n, some, warned = ask(copy)
    assert n > 200 and not some and warned
