"""The package reaches the workers wherever the program runs."""

import os
import subprocess
import sys
import textwrap

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_run_from_another_folder_finds_the_package_in_its_workers(tmp_path):
    program = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {TOP!r})
        from pyspark.sql import SparkSession
        import __spark_entry__ as entry
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        print("rows", entry.queries()["text_repair"](spark, "/root/testdata/sf0.001").toPandas().shape[0])
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
