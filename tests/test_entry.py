"""The entry point without the parts that may be removed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path


def test_the_rest_works_without_the_removable_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py", "orbweave"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "orbweave" / "llm", ignore_errors=True)
    for drop in ((), ("corpus_pipeline.py",)):
        for name in drop:
            (tmp_path / name).unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and q and all(k.startswith('q_') for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
