"""Python workers must not need an installed copy of the package: run the
mapInPandas step from another working directory in a fresh process."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from quire.operators.markdown import html_to_markdown
df = spark.createDataFrame([(1, "<h1>T</h1><p>x</p>")], "page_id int, html string")
print("RESULT", html_to_markdown(df).first().markdown.replace(chr(10), "|"))
spark.stop()
"""


def test_workers_import_free():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    cwd = tempfile.mkdtemp(prefix="quire-cwd-")  # a fresh folder, left in place
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "RESULT # T||x" in out.stdout, out.stderr[-2000:]
