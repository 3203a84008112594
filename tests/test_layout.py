"""The library works without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_llm():
    for f in (ROOT / "quadloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "quadloom.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quadloom", tmp_path / "quadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr[-500:]
