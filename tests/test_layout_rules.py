"""The rest works without the training-data operators, with the pipeline's file or without."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; n = set(e.queries()); assert set(e.oracle_sql()) <= n; print(len(n), sorted(x for x in n if x.startswith('op') or x == 'pipeline'))"


def listed(at: Path) -> str:
    return subprocess.run([sys.executable, "-c", LOOK], cwd=at, capture_output=True, text=True, check=True).stdout


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_llm_folders(tmp_path, pipeline_too):
    at = tmp_path / "copy"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if pipeline_too:
        (at / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(at).rstrip().endswith("[]")


def test_nothing_else_imports_the_llm_folder():
    for path in [*REPO.glob("quadrille/**/*.py"), *REPO.glob("tests/*.py")]:
        if "llm" not in path.relative_to(REPO).parts:
            assert "import " + "quadrille.llm" not in path.read_text() and "from " + "quadrille.llm" not in path.read_text(), path
