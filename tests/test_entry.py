"""The driver's three functions also work where the corpus operators are away."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_rest_stands_alone(tmp_path):
    """A copy without the corpus operators, their tests and (once more) their pipeline still imports and has the rest."""
    here = tmp_path / "copy"
    shutil.copytree(ROOT, here, ignore=lambda d, names: {".git", "__pycache__", *({"llm"} & set(names))})
    ask = "import __spark_entry__ as e; assert e.oracle_sql().keys() <= e.queries().keys(); print(*sorted(e.queries()))"
    own = sorted(entry._own.QUERIES)
    for _ in range(2):
        got = subprocess.run([sys.executable, "-B", "-c", ask], cwd=here, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
        assert got.stdout.split() == own
        (here / "corpus_pipeline.py").unlink(missing_ok=True)


def test_all_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
