import subprocess
import sys

from places import ROOT

from loomtext.runtime import Scratch, shared_dir
from loomtext.sources import config as G

SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from loomtext.functions import matching as M
print("GOT", spark.createDataFrame([("running",)], "x string").select(M.stem(F.col("x"))).first()[0])
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GOT run" in out.stdout, out.stderr[-2000:]


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark, "test")
    rows = s.write(spark.range(3), "a")
    assert rows.count() == 3 and s.root.startswith(shared_dir(spark))
    s.drop("a")
    s.drop("never-written")


def test_node_configuration():
    text = 'project "x" {\n  // note\n  index { max_file_size 10; follow true }\n  exclude "a" "b"\n}\nratio 0.5\nexclude "c"\nexclude "d e"\n'
    got = G.load(text)
    assert got["project"]["index"] == {"max_file_size": 10, "follow": True} and got["project"]["exclude"] == ["a", "b"]
    assert got["ratio"] == 0.5 and got["exclude"] == ["c", "d e"]
    assert G.load('{"a": 1}', "json") == {"a": 1}


def test_project_over_base():
    got = G.merged(G.DEFAULTS, {"search": {"max_results": 5}, "exclude": ["x"]})
    assert got["search"] == {"max_results": 5, "max_context_lines": 0} and got["exclude"][-1] == "x" and "**/vendor/**" in got["exclude"]


def test_propagation_rules(spark):
    good = G.Propagation((G.PropagationRule("critical"), G.PropagationRule("io", mode="decay")))
    assert G.problems(good) == [] and G.rules_table(spark, good).count() == 2
    bad = G.Propagation((G.PropagationRule("a", mode="x", decay=2.0), G.PropagationRule("a", direction="up")), max_iterations=0)
    assert len(G.problems(bad)) == 5
