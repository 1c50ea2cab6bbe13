"""The entry module with and without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def said(root: Path) -> list[str]:
    """Counts of queries, as another process sees them."""
    return subprocess.run([sys.executable, "-c", SAY], cwd=root, capture_output=True, text=True, check=True).stdout.split()


@pytest.fixture
def copy(tmp_path):
    """The package and its entry, without tests and history."""
    shutil.copytree(ROOT / "stratoloom", tmp_path / "stratoloom", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_corpus_operators(copy):
    """Everything else stays."""
    shutil.rmtree(copy / "stratoloom" / "llm", ignore_errors=True)
    count, ops, pipeline = said(copy)
    assert int(count) > 150 and ops == "0" and pipeline == "False"


def test_other_errors_are_not_hidden(copy):
    """Only the absence of the optional part is passed over."""
    (copy / "stratoloom" / "llm").mkdir(exist_ok=True)
    (copy / "stratoloom" / "llm" / "__init__.py").write_text("")
    (copy / "stratoloom" / "llm" / "registry.py").write_text("import no_such_module")
    with pytest.raises(subprocess.CalledProcessError):
        said(copy)


def test_nothing_imports_the_corpus_operators():
    """The rest of the library knows nothing of them."""
    for p in (ROOT / "stratoloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()
