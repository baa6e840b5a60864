"""The driver's entry with and without the training-data subpackage."""
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder) -> list[str]:
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_entry_imports_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    n, pipeline, known = shown(copy)
    assert int(n) >= 127 and (pipeline, known) == ("False", "True")
    (copy / "decisionlake" / "llm").mkdir()                 # an empty folder is not a package either
    assert shown(copy) == [n, pipeline, known]
