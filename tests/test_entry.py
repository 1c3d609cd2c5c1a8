"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_subpackage(tmp_path):
    shutil.copytree(ROOT / "glimmer", tmp_path / "glimmer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not [k for k in q if k.startswith('op')], q; print(len(q))"
    # an empty folder of that name is no subpackage either
    for extra in (False, True):
        if extra:
            (tmp_path / "glimmer" / "llm").mkdir()
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and int(out.stdout) > 60, out.stderr
