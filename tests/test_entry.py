"""The entry point with the corpus subpackage whole, gone, or broken."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q, 'q3' in q)"


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda llm: None, "0 False True"),
        (lambda llm: llm.mkdir(), "0 False True"),  # an empty folder
        (lambda llm: (llm.mkdir(), (llm / "__init__.py").write_text("import zstandard_of_nowhere\n")), "0 False True"),
        (lambda llm: (llm.mkdir(), (llm / "__init__.py").write_text("from . import mistyped\n")), None),
        (lambda llm: (llm.mkdir(), (llm / "__init__.py").write_text("from ..storage import mistyped\n")), None),
    ],
)
def test_only_what_is_not_there_is_left_out(tmp_path, change, said):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "ringfold", tmp_path / "ringfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    change(tmp_path / "ringfold" / "llm")
    ran = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    if said is None:
        assert ran.returncode != 0 and "mistyped" in ran.stderr
    else:
        assert ran.stdout.split("\n")[-2] == said and "corpus queries are left out" in ran.stderr
