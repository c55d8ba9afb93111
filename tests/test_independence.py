"""The core works on a copy without the training-data folders."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).parent.parent


def test_queries_without_llm(tmp_path):
    for name in ("casegraph", "__spark_entry__.py", "corpus_pipeline.py"):
        source = HERE / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm05_participation' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_in_the_core_imports_llm():
    for path in (HERE / "casegraph").rglob("*.py"):
        if "llm" not in path.relative_to(HERE).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path
