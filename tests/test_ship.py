import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from codeloom.api import Graph
graph = Graph.build(spark, "s", {{"app": {tree!r}}})
print("edges", sorted((r["edge_type"], r["to_name"]) for r in graph.edges.collect() if r["edge_type"] == "CALLS_SYMBOL"))
"""


def test_a_build_needs_the_package_on_the_driver_alone(tmp_path):
    """Workers start in another folder and without the package on their path."""
    top, tree = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "app"
    tree.mkdir()
    (tree / "a.py").write_text("def f():\n    g()\ndef g():\n    pass\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(top=top, tree=str(tree))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "edges [('CALLS_SYMBOL', 'g')]" in done.stdout, done.stderr[-2000:]
