"""Executors have the third-party libraries, but not this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")


def found(batches):
    import importlib.util

    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("grainline") is not None])], ["there"])


assert not spark.range(1).mapInArrow(found, "there boolean").first()["there"]
sys.path.insert(0, sys.argv[1])
from grainline.llm import queries

for key in sys.argv[3:]:
    rows = queries.QUERIES[key](spark, "/root/testdata/sf0.001").collect()
    print("rows of", key, len(rows))
"""


@pytest.mark.parametrize("keys", [
    ["op1_exact_topk", "op9_hmm_scoring", "op12_hard_negatives"],
    ["op3_toxicity", "op4_super_minhash", "op6_bwt_dedup", "op7_fm_decontamination"],
    ["op10_bpe", "op11_token_counts", "op13_spelling_variants"],
])
def test_queries_where_workers_lack_the_package(tmp_path, keys):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != Path(REPO)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    done = subprocess.run([sys.executable, str(script), REPO, str(tmp_path / "shared"), *keys],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[2] for line in done.stdout.splitlines() if line.startswith("rows of")] == keys
