"""The entry point without the optional subpackage or what it needs."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q = e.queries()
print(len(q), sum(n.startswith("op") or n == "pipeline" for n in q), {{*e.oracle_sql()}} <= {{*q}})
"""


def listed(*names):
    out = subprocess.run([sys.executable, "-c", HIDDEN.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_entry_without_the_subpackage_or_its_libraries():
    total, ops, fine = listed()
    assert fine == "True"
    for name in ("prismfeed.llm", "corpus_pipeline", "public_tokenizers", "zstandard", "sentencepiece", "tokenizers", "regex"):
        left, some, fine = listed(name)
        assert (int(left) - int(some), fine) == (int(total) - int(ops), "True") and some in ("0", ops), name
        assert some == "0" or "." not in name and name != "corpus_pipeline", name
