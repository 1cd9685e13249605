"""Headline queries, timed. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from palimpsest.plans.queries import QUERIES

#: through a stored database, which the first of the two runs builds.
HEADLINE = [
    "fast_count", "scan_filter", "range_scan", "in_list", "agg_group", "agg_distinct", "join_inner", "join_self_versions", "win_row_number", "topk", "diff_rows", "diff_stat", "diff_keyless", "column_diff",
    "history", "blame", "diff_table", "merge_classify", "merge_rows", "merge_conflicts", "viol_fk", "viol_unique", "upsert", "query_diff_pk", "stats_histogram", "vector_topk",
    "repo_as_of_tag", "repo_diff", "repo_diff_stat", "repo_history", "repo_blame", "repo_diff_table", "repo_commit_diff", "repo_column_diff", "repo_preview",
]
ROWS = 400_000


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    s = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def ingest(spark: SparkSession) -> float:
    """Seconds to import a CSV of 400,000 sorted rows with an integer key into a new versioned table."""
    from palimpsest.plans.store import Repo
    from palimpsest.sources import files

    with tempfile.TemporaryDirectory() as d:
        spark.range(ROWS).selectExpr("id AS pk", "id * 7 % 1000 AS c1", "concat('value ', id) AS c2").coalesce(1).write.option("header", True).csv(f"{d}/in")
        repo = Repo(spark, f"{d}/repo")
        began = time.perf_counter()
        files.load(repo, "t", f"{d}/in", kind="csv", keys=["pk"])
        return time.perf_counter() - began


def changes(spark: SparkSession) -> dict[str, float]:
    """Seconds to change one row of a stored table of 400,000, and to merge two branches that changed some rows each."""
    from palimpsest.plans.store import Repo

    took = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - began, 3)

    with tempfile.TemporaryDirectory() as d:
        repo = Repo(spark, f"{d}/repo", rows_per_bucket=1 << 14)
        repo.write_table("t", spark.range(ROWS).selectExpr("id AS pk", "id * 7 % 1000 AS c1", "concat('value ', id) AS c2"), ["pk"])
        repo.commit("base", all=True)
        timed("repo_update_one_of_400k", lambda: repo.update("t", {"c1": "-1"}, "pk = 77"))
        timed("repo_diff_one_of_400k", lambda: repo.diff("HEAD", "WORKING", "t").collect())
        repo.commit("ours", all=True)
        repo.create_branch("other", "HEAD~1")
        repo.checkout("other")
        repo.update("t", {"c2": "'x'"}, "pk % 50000 = 1")
        repo.commit("theirs", all=True)
        repo.checkout("main")
        timed("repo_merge_400k", lambda: repo.merge("other"))
    return took


def main() -> None:
    spark = session()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    took: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    took |= changes(spark)
    took["import_csv_400k"] = round(min(ingest(spark) for _ in range(2)), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, best of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
