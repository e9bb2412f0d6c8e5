"""The entry loads without the training-data subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def loaded(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    return run.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(HERE, "lexisieve"), tmp_path / "lexisieve", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(HERE, name)):
            shutil.copy(os.path.join(HERE, name), tmp_path / name)
    number, numbered, pipeline = loaded(tmp_path)
    assert int(number) > 90 and numbered == pipeline == "False"
