"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The reference's figures are whole-table analyses, so the headline is analyze() on lineitem: exact over every row, and
on a sample, as the reference does from 50,000 rows on.  Each query is run once to compile, then timed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

import clearbrook as cb
from clearbrook import queries

HEADLINE = ["profile_numeric", "profile_categorical", "profile_duplicates", "profile_patterns", "detect_missing", "detect_outliers_iqr", "detect_case", "detect_similar", "fill_median", "clean_empty", "clip_iqr", "dedup_first", "types_numeric", "fmt_dates", "stratified_sample", "end_to_end_clean"]
MOST_SECONDS = float(os.environ.get("BENCH_SECONDS", "900"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="bench-")}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = line.count()
    out: dict[str, float] = {}
    began = time.time()

    def timed(name: str, run, again: bool = True) -> None:  # noqa: ANN001
        if time.time() - began > MOST_SECONDS:
            return
        for _ in range(1 + again):
            t = time.time()
            run()
            out[name] = round(time.time() - t, 3)

    timed("analyze_lineitem_exact", lambda: cb.analyze(line, sample=False))
    timed("analyze_lineitem_sample", lambda: cb.analyze(line, sample=True))
    timed("analyze_lineitem_approximate", lambda: cb.analyze(line, sample=False, approximate=True), again=False)
    for name in HEADLINE:
        timed(name, lambda f=queries.QUERIES[name]: f(spark, sf).write.format("noop").mode("overwrite").save())
    try:
        from clearbrook.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, f in QUERIES.items():
        timed(name, lambda f=f: f(spark, sf).write.format("noop").mode("overwrite").save(), again=False)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf.rpartition("sf")[2], "analyze_rows": rows, "exact_rows_per_second": round(rows / out["analyze_lineitem_exact"])}))
    spark.stop()


if __name__ == "__main__":
    main()
