"""The driver contract holds without the llm subpackage and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "rangeloom", tmp_path / "rangeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and set(e.queries()) == set(e.oracle_sql()); print('fine')"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0
