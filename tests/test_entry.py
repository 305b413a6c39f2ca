"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    for part in ("concord", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "concord/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 40)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == ["0", "True"], said.stderr
