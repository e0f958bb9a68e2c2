import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith(("evidencelake.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [k for k in e.queries() if k.startswith("op") or k == "pipeline"], e.queries().keys()
assert set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()))
"""


def test_works_without_the_training_data_operators():
    done = subprocess.run([sys.executable, "-B", "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100


FAULT = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "evidencelake.sources.stage":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
"""


def test_a_real_import_fault_is_not_hidden():
    done = subprocess.run([sys.executable, "-B", "-c", FAULT], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode and "evidencelake.sources.stage" in done.stderr


def test_nothing_else_imports_them():
    for path in ROOT.glob("evidencelake/**/*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "metric", "value"] and df.count() > 0
