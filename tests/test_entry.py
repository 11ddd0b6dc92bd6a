"""The entry works without the training-data operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


def probe(root):
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1])


def copied(tmp_path, *left_out):
    root = tmp_path / "tree"
    root.mkdir()
    shutil.copytree(os.path.join(REPO, "shotloom"), root / "shotloom", ignore=shutil.ignore_patterns("__pycache__", *[n for n in left_out if "." not in n]))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(REPO, name)):
            shutil.copy(os.path.join(REPO, name), root)
    return root


def test_entry_imports_without_the_operator_folder(tmp_path):
    total, dealt = probe(copied(tmp_path, "llm"))
    assert total > 190 and dealt == 0


def test_entry_imports_without_folder_and_pipeline(tmp_path):
    total, dealt = probe(copied(tmp_path, "llm", "corpus_pipeline.py"))
    assert total > 190 and dealt == 0
