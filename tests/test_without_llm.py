"""The library without the training-data operators."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_alone(tmp_path):
    shutil.copytree(ROOT / "covenant", tmp_path / "covenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = (
        "import pkgutil, importlib, covenant, __spark_entry__ as e\n"
        "for m in pkgutil.walk_packages(covenant.__path__, 'covenant.'): importlib.import_module(m.name)\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert len(q) > 60 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": "/tmp"}, check=True, timeout=120)


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "covenant").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text())
