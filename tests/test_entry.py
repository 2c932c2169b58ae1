"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_corpus_subpackage(tmp_path):
    for name in ("spanloom", "__spark_entry__.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    if (tmp_path / "spanloom/llm").exists():
        (tmp_path / "spanloom/llm").rename(tmp_path / "gone")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False"
