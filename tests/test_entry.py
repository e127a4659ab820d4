import __spark_entry__ as entry

ROWS = {"e11_scope", "e14_source_metadata", "a27_trigger_events"}


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert ROWS <= set(queries) and len(queries) >= 80


def test_subpackage_queries_come_only_with_it():
    import importlib.util

    names = {n for n in entry.queries() if n.startswith("op")}
    assert bool(names) == bool(importlib.util.find_spec("codeloom.llm") and importlib.util.find_spec("codeloom.llm.queries"))


def test_small_queries_run(spark):
    queries = entry.queries()
    for name in ROWS:
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(top, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    for without in ((), ("corpus_pipeline.py",)):
        for name in without:
            os.remove(tmp_path / "copy" / name) if os.path.exists(tmp_path / "copy" / name) else None
        run = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
        assert run.returncode == 0, run.stderr
        found, oracles, optional = run.stdout.split()
        assert int(found) >= 80 and int(oracles) >= 70 and optional == "False"
