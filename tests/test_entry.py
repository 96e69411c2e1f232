"""The entry loads the other queries when the training-data subpackage, or what it needs, is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from watchtide.catalog import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["watchtide.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_entry_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout
    names, oracles = (part.split() for part in out.split("|"))
    assert names == sorted(QUERIES) and oracles == sorted(ORACLES)
