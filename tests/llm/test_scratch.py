"""Scratch tables are gone when the driver has ended."""

import os
import subprocess
import sys

CODE = """
from fitloom.session import get_spark
from fitloom.llm.common import scratch
spark = get_spark("local[2]", 2, extra={"spark.checkpoint.dir": "%s"})
kept = scratch(spark.range(100).toDF("n"), "numbers")
assert kept.count() == 100
spark.stop()
"""


def test_scratch_tables_go_with_the_driver(tmp_path):
    shared = tmp_path / "shared"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", CODE % shared], cwd=root, check=True, timeout=240)
    assert not list(shared.rglob("numbers-*"))


def test_bucketed_tables_go_with_the_driver(tmp_path):
    shared = tmp_path / "shared"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = CODE.replace("import scratch", "import scratch_by").replace('scratch(spark.range(100).toDF("n"), "numbers")',
                                                                        'scratch_by(spark.range(100).toDF("n"), "numbers", "n")')
    subprocess.run([sys.executable, "-c", code % shared], cwd=root, check=True, timeout=240)
    assert not list(shared.rglob("numbers-*"))
