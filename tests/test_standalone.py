"""Queries on a standalone master, whose executors get the package from the driver; one session, the entry file loaded anew for each query."""

import json
import os
import socket
import subprocess
import sys
import time

import duckdb
import pandas as pd
import pyspark
import pytest

from sievework.plans import catalogue
from test_oracle import SF, rows

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: One for each finding that they failed by an error.
QUERIES = [
    "q02_path_order",
    "q03_content_hash",
    "q04_exact_dup_groups",
    "q06_cache_misses",
    "q05_cache_hits",
    "q08_norms",
    "q07_cache_merge",
    "q09_similar_pairs",
    "q11_components",
    "q12_cluster_ids",
    "q10_pair_count_by_label",
    "q13_cluster_members",
    "q14_rep_first",
    "q17_unique_images",
    "q16_duplicates",
    "q15_rep_best",
    "q18_aesthetic",
    "q22_final_score",
    "q21_parse_score",
    "q19_score_stats",
    "q20_llm_candidates",
    "q23_top_n",
]
RUN = """
import importlib.util, json, os, sys
from pyspark.sql import SparkSession
master, home, sf, out, *names = sys.argv[1:]
sys.path.insert(0, home)
spark = SparkSession.builder.master(master).config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", f"file://{out}/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def entry():
    spec = importlib.util.spec_from_file_location("entry_loaded_anew", os.path.join(home, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.queries()
entry()["q26_folder_counts"](spark, sf).count()
errors = {}
for name in names:
    try:
        entry()[name](spark, sf).write.parquet(f"{out}/{name}")
    except Exception as e:
        errors[name] = str(e)[:500]
with open(f"{out}/errors.json", "w") as f:
    json.dump(errors, f)
"""


@pytest.fixture(scope="module")
def ran(tmp_path_factory):
    out = tmp_path_factory.mktemp("standalone")
    spark_home = os.path.dirname(pyspark.__file__)
    env = os.environ | {"SPARK_HOME": spark_home, "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(out / "local"), "TZ": "UTC"}
    env.pop("PYTHONPATH", None)  # executors have only what they are sent
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    start = [os.path.join(spark_home, "bin", "spark-class")]
    quiet = {"env": env, "cwd": out, "stdout": subprocess.DEVNULL, "stderr": subprocess.DEVNULL}
    daemons = [subprocess.Popen([*start, "org.apache.spark.deploy.master.Master", "--host", "127.0.0.1", "--port", str(port), "--webui-port", "0"], **quiet)]
    try:
        for _ in range(300):
            with socket.socket() as s:
                if s.connect_ex(("127.0.0.1", port)) == 0:
                    break
            time.sleep(0.1)
        daemons.append(subprocess.Popen([*start, "org.apache.spark.deploy.worker.Worker", "--host", "127.0.0.1", "--webui-port", "0", "-c", "4", "-m", "2g", "-d", str(out / "work"), f"spark://127.0.0.1:{port}"], **quiet))
        subprocess.run([sys.executable, "-c", RUN, f"spark://127.0.0.1:{port}", HOME, SF, str(out), *QUERIES], env=env, cwd=out, check=True, timeout=600, capture_output=True)
    finally:
        for daemon in reversed(daemons):
            daemon.terminate()
            daemon.wait(30)
    return out, json.loads((out / "errors.json").read_text())


@pytest.mark.parametrize("name", QUERIES)
def test_query_off_a_local_master_equals_sql(ran, name):
    out, errors = ran
    assert name not in errors, errors[name]
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    got = pd.read_parquet(out / name)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns) and len(want)
