"""The driver's contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"report_totals", "grep_near", "knn_cosine", "parse_codex"} <= set(__spark_entry__.oracle_sql())


def test_the_rest_stands_without_the_optional_parts(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'daily_breakdown' in names and not any(n.startswith('op') or n == 'pipeline' for n in names), names; e.oracle_sql()"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    tests = [
        sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_fulltext.py", "tests/test_parsers.py", "-k",
        "stems or kinds or outside"
    ]
    done = subprocess.run(tests, cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout


def test_a_broken_optional_part_is_no_missing_one(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    package = tmp_path / "repo" / "colloquy" / "llm"
    if not package.exists():
        return
    (package / "queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        capture_output=True, text=True
    )
    assert done.returncode and "no_such_module_at_all" in done.stderr


def test_the_flagship_query(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        rows = __spark_entry__.entry(spark).collect()
        assert len(rows) == 30 and rows[0].session_count > 0
