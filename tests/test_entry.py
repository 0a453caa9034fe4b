"""The entry module offers the core queries whatever the training-data part lacks."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = entry.queries()
assert set(entry.oracle_sql()) <= set(names)
print(len(names), any(n.startswith("op") or n == "pipeline" for n in names), "dedup_works" in names)
"""


@pytest.mark.parametrize("blocked", ["corpus_pipeline", "evidence_lake.llm", "public_tokenizers", "evidence_lake.llm.queries", "evidence_lake.llm.packing"])
def test_core_queries_stay(blocked):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(blocked=(blocked,))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, training, core = done.stdout.split()[-3:]
    assert int(count) >= 60 and (training, core) == ("False", "True")
    assert "without the training-data queries" in done.stderr
