"""Run the queries of tabulant.llm beside their SQL: python tests/llm/check_queries.py [name ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))]

from check_oracles import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tabulant.llm.queries import ORACLES, QUERIES  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINTS", "/tmp/llm-checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    for name in sys.argv[1:] or QUERIES:
        t = time.time()
        df = QUERIES[name](spark, sf)
        if name in ORACLES:
            print(name, compare(df, con, ORACLES[name]) or "ok", round(time.time() - t, 1), flush=True)
        else:
            rows = df.collect()
            print(name, "rows", len(rows), round(time.time() - t, 1), df.dtypes, *rows[:3], sep="\n  ", flush=True)
