import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_needs_the_optional_operators():
    for p in (ROOT / "broadsheet").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_entry_works_without_them(tmp_path):
    import shutil

    shutil.copytree(ROOT / "broadsheet", tmp_path / "broadsheet", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
