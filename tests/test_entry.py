"""The entry without the optional subpackage: in a copy of the repository, in a Python of its own."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
RUN = """
import __spark_entry__ as entry
from leafmill.session import session
names, sql = entry.queries(), entry.oracle_sql()
assert set(sql) <= set(names) and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), sorted(names)
spark = session("entry", **{"spark.master": "local[1]", "spark.ui.enabled": "false"})
print("ROWS", len(names), names["catalog_total"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(TOP / "leafmill", tmp_path / "leafmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (TOP / "corpus_pipeline.py").exists() else [])):
        shutil.copy(TOP / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-3000:]
    _, queries, rows = said.stdout.strip().splitlines()[-1].split()
    assert int(queries) >= 77 and rows == "1"
