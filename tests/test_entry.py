"""The entry module works with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "session_metrics" in e.queries()
    assert all(isinstance(s, str) and s for s in e.oracle_sql().values())


def test_without_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "tidemark", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tidemark").mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name != "llm":
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'session_metrics' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
