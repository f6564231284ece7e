"""What has to hold with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lexistrata").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_imports_without_the_subpackage(tmp_path):
    for path in [ROOT / "__spark_entry__.py", *(p for p in (ROOT / "lexistrata").rglob("*.py") if "llm" not in p.parts)]:
        to = tmp_path / path.relative_to(ROOT)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["term", "freq", "ref", "g2", "log_ratio", "badge"]
