"""The rest works without the training-data subpackage."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for path in [*ROOT.glob("graphspun/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts or not path.exists():
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "graphspun", tmp_path / "graphspun", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) == len(s) > 30 and not any(n[:2] == 'op' and n[2].isdigit() for n in q); print('ok')"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.strip() == "ok"


def test_tests_without_it(tmp_path):
    """What is left is collected: no module of the rest's tests needs the subpackage."""
    shutil.copytree(ROOT / "graphspun", tmp_path / "graphspun", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0 and "test_person_page" in done.stdout, done.stdout + done.stderr
