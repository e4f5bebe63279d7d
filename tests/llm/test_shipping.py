import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corpusmill.llm import decontamination, near_dedup, pii, token_counts
docs = spark.createDataFrame([(1, "mail a@b.cd " + "one two three four five six seven eight nine ten " * 3)], "doc_id long, text string")
items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
print("found", pii.personal_data(docs).first()["n_email"], decontamination.contaminated(docs, items).first()["item_id"], near_dedup.near_duplicates(docs).count(), token_counts.encoded_lengths(docs).count())
"""


def test_functions_travel_to_workers_that_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1 7 1 1" in done.stdout, done.stderr[-2000:]
