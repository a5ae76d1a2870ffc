import ast
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "spoorlake").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_the_rest_stands_without_the_training_data_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in (copy / "spoorlake/llm", copy / "tests/llm"):
        shutil.rmtree(path, ignore_errors=True)

    def run(*args):
        done = subprocess.run([sys.executable, *args], cwd=copy, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stdout + done.stderr
        return done.stdout

    names = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    mine = {n for n in entry.queries() if not (n == "pipeline" or n.startswith("op") and n[2].isdigit())}
    for removed in (None, copy / "corpus_pipeline.py"):  # with and without the pipeline's file
        if removed:
            removed.unlink(missing_ok=True)
        assert set(run("-c", names).split()) == mine
    run("-m", "pytest", "--collect-only", "-q", "tests")


def test_queries_match_oracles(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "labels", "customer", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("tool_pairs_greedy", "orphan_to_round_asof", "parallel_metrics", "near_dup_pairs", "leaf_paths", "registry_ceiling"):
        got = entry.queries()[name](spark, SF).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        clean = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[cols].astype(object).itertuples(index=False))  # noqa: E731,B023
        assert cols == sorted(want.columns) and clean(got) == clean(want), name
