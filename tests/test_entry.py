"""The core queries stay when the optional subpackage, or a library that only it needs, is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from logweave.plans.queries import QUERIES

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers", "corpus_pipeline", "logweave.llm"])
def test_core_queries_without(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import warnings; warnings.simplefilter('ignore')\n"
        "import __spark_entry__ as entry\n"
        "print(len(entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), "True"], done.stderr
