"""The package without its text operators: it imports, and nothing in it needs them."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_engine_stands_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "fieldloom", tmp_path / "fieldloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'regional_rmse' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_the_text_operators():
    for p in (ROOT / "fieldloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "fieldloom").parts:
            assert not re.search(r"^\s*(from|import)\s+.*\bllm\b", p.read_text(), re.M), p
