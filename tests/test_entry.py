"""The driver's entry without the modules that may be absent."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == 'op' or n == 'pipeline' for n in e.queries()))"


def counts(folder, before=""):
    run = subprocess.run([sys.executable, "-c", before + SAY], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder) + os.pathsep + os.environ.get("PYTHONPATH", ""), "PYTHONDONTWRITEBYTECODE": "1"})
    assert run.returncode == 0, run.stderr
    return tuple(map(int, run.stdout.split()))


@pytest.fixture
def copied(tmp_path):
    return pathlib.Path(shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")))


@pytest.mark.parametrize("gone", [("plinth/llm", "tests/llm"), ("plinth/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_folders_may_be_gone(copied, gone):
    for name in gone:
        place = copied / name
        if place.is_dir():
            shutil.rmtree(place)
        elif place.exists():
            place.unlink()
    queries, oracles, optional = counts(copied)
    assert queries > 50 and oracles > 50 and (optional == 0 or gone == ("corpus_pipeline.py",))


def test_a_folder_may_be_left_without_its_modules(copied):
    if (copied / "plinth" / "llm").exists():
        shutil.rmtree(copied / "plinth" / "llm")
    (copied / "plinth" / "llm" / "__pycache__").mkdir(parents=True)
    assert counts(copied)[2] == 0


def test_tokenizers_may_be_absent(copied):
    assert counts(copied, "import sys; sys.modules['public_tokenizers'] = None; ")[2] == 0


def test_other_errors_show(copied):
    (copied / "corpus_pipeline.py").write_text("import nosuchmodule\n")
    with pytest.raises(AssertionError, match="nosuchmodule"):
        counts(copied)
