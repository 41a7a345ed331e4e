import subprocess
import sys

import pytest

from sellerlens.catalog import QUERIES
from tests.conftest import ROOT


@pytest.mark.parametrize("missing", ["sellerlens.llm", "corpus_pipeline", "ahocorasick", "public_tokenizers", "tokenizers"])
def test_core_queries_stay_without_the_training_data_operators(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES))] * 2
