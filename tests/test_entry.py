"""The driver's entry points stand without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys, warnings
sys.path.insert(0, {root!r})
for name in {gone!r}:
    sys.modules[name] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
names = set(e.queries())
assert len([n for n in names if not n.startswith("op") and n != "pipeline"]) > 120 and set(e.oracle_sql()) <= names
print(sum(n.startswith("op") for n in names), "pipeline" in names, " ".join(str(w.message) for w in said if "left out" in str(w.message)))
"""


def answer(*gone):
    return subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), gone=gone)], capture_output=True, text=True, check=True).stdout.split(maxsplit=2)


def test_a_missing_package_is_named_and_the_other_queries_stay():
    assert answer("zstandard")[::2] == ["0", "fieldwave.llm.registry is left out: zstandard is missing\n"]


def test_without_the_subpackage_nothing_is_said():
    assert answer("fieldwave.llm", "corpus_pipeline") == ["0", "False"]
