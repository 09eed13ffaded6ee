"""The driver contract, with and without the text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, sum(n.startswith('op') for n in q))"


@pytest.mark.parametrize("dropped", [(), ("gesso/llm",), ("gesso/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_what_may_be_deleted(tmp_path, dropped):
    copy = tmp_path / "repo"
    left_out = [ROOT / d for d in dropped]

    def skip(folder, names):
        return [n for n in names if Path(folder) / n in left_out or n in (".git", "tests", "__pycache__")]

    shutil.copytree(ROOT, copy, ignore=skip)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    total, pipeline, numbered = out.stdout.split()
    here = (ROOT / "gesso/llm").is_dir() and "gesso/llm" not in dropped
    assert int(total) > 200 and (int(numbered) > 0) == here
    assert (pipeline == "True") == (here and (ROOT / "corpus_pipeline.py").exists() and "corpus_pipeline.py" not in dropped)
