"""The driver contract where the optional corpus subpackage cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
_NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, 'ag8_corpus_metrics' in q)"


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "lectern.llm", "zstandard"])
def test_core_queries_stay_without(hidden):
    run = subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.modules[{hidden!r}] = None; {_NAMES}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    count, corpus, core = run.stdout.split()[-3:]
    assert int(count) >= 90 and core == "True"
    assert corpus == "False"
