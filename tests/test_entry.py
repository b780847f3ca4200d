"""The driver's entry points, with the corpus operators and without them."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(*q); assert set(o) <= set(q) and 'ndvi_time_series' in q"


def names(folder: Path) -> set[str]:
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, left):
    """With the operators' folders deleted, and the pipeline's file with them or still there."""
    shutil.copytree(ROOT / "rasterloom", tmp_path / "rasterloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (ROOT / name).is_file():
            shutil.copy(ROOT / name, tmp_path)
    assert not any(re.match(r"op\d+_", n) or n == "pipeline" for n in names(tmp_path))


@pytest.mark.skipif(not (ROOT / "rasterloom/llm").is_dir() or not (ROOT / "corpus_pipeline.py").is_file(), reason="corpus operators removed")
def test_entry_with_the_corpus_operators():
    found = names(ROOT)
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 14))


def test_nothing_else_imports_the_corpus_operators():
    for p in [*ROOT.glob("rasterloom/**/*.py")]:
        if "llm" not in p.parts:
            assert "rasterloom.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p


def test_flagship(spark):
    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no test tables")
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    series = __spark_entry__.entry(spark).collect()
    assert 0 < len(series) <= 12 and [r.date for r in series] == sorted(r.date for r in series)
