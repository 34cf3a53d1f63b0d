"""The driver's functions, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_library_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "heron", tmp_path / "heron", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 180 and not [x for x in q if x.startswith('op')], len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__

    if __spark_entry__.llm:
        names = __spark_entry__.queries()
        assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
