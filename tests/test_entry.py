"""The entry module without the training-data part, and without each library that this part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = "import sys; sys.modules[{name!r}] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), 'rankings' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash", "regex", "sentencepiece", "corpus_pipeline", "strandline.llm"])
def test_other_queries_stay(name):
    got = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-800:]
    n, has, rankings, sql = got.stdout.split()
    assert int(n) > 100 and has == "False" and rankings == "True" and sql == "True"
