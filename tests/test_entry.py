"""The driver's contract, with and without the optional parts."""

import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_entry_gives_the_flagship(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "vector_score", "lexical_score", "rerank_score", "rank"] and found.count() == 10


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_optional_parts_can_be_missing(tmp_path, left):
    """Without the optional package, with or without the pipeline's file, the entry imports and lists the other queries."""
    for name in ("__spark_entry__.py", "ragmill", *(x for x in left if (ROOT / x).exists())):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q = {**e.queries(), **e.oracle_sql()}; print('hybrid_query' in q, any(n.startswith('op') or n == 'pipeline' for n in q))"
    # The copy alone is on the path, whatever PYTHONPATH says.
    said = subprocess.run([sys.executable, "-I", "-c", code, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == ["True", "False"]
