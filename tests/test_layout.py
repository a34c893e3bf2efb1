"""The engine stands without its subpackage for training data."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "sorkuvai").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(encoding="utf-8")


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['sorkuvai.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('p') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
