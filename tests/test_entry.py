import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_registered_queries(spark):
    names = __spark_entry__.queries()
    assert "top_pairs" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_engine_stands_without_the_llm_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; n = list(e.queries()); assert 'top_pairs' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
