import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_imports_without_the_optional_folder(tmp_path, keep_pipeline):
    """All other queries are registered where the llm folder is gone, with or without the pipeline file."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if not keep_pipeline and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names, sql = json.loads(said.stdout.splitlines()[-1])
    assert len(names) >= 110 and set(sql) <= set(names)
    assert "pipeline" not in names and not [n for n in names if n.startswith("op")]
