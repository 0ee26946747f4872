"""The run ledger: one appended row per run state change (REF-14..16, WIN-4).

A run writes a ``running`` row when it starts and a final row when it ends,
both under the same ``run_id``; the current state of a run is its latest row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS_SCHEMA = (
    "run_id bigint, chart string, from_date date, to_date date, batch_size int, status string, "
    "row_count bigint, batches_completed int, error_message string, force boolean, "
    "started_at timestamp_ntz, completed_at timestamp_ntz"
)


def runs_path(root: str) -> str:
    return f"{root.rstrip('/')}/_runs"


def run_row(run_id, chart, from_date, to_date, batch_size, status, rows, batches, error, force, started, completed):
    return (run_id, chart, from_date, to_date, batch_size, status, rows, batches, error, force, started, completed)


def record_run(spark: SparkSession, root: str, row: tuple) -> None:
    """REF-14: add one ledger row.

    Each row is its own small write into its own folder, so runs of different
    charts recording at the same time never share a staging directory.
    """
    run_id, status = row[0], row[5]
    spark.createDataFrame([row], RUNS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{runs_path(root)}/{run_id}-{status}"
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every ledger row (empty with the ledger schema when none was written)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(runs_path(root))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RUNS_SCHEMA)
    return spark.read.schema(RUNS_SCHEMA).option("recursiveFileLookup", "true").parquet(runs_path(root))


def current_runs(ledger: DataFrame) -> DataFrame:
    """The latest row of each run, by aggregate (no per-run window buffer).

    Ties between a ``running`` row and a final row with the same timestamp are
    broken toward the final row.
    """
    order = F.struct(
        F.coalesce(F.col("completed_at"), F.col("started_at")).alias("t"),
        (F.col("status") != "running").cast("int").alias("final"),
    )
    cols = [c for c in ledger.columns if c != "run_id"]
    latest = ledger.groupBy("run_id").agg(F.max_by(F.struct(*cols), order).alias("r"))
    return latest.select("run_id", "r.*")


def mark_stale_runs(runs: DataFrame, now: _dt.datetime, max_age_minutes: int = 120) -> DataFrame:
    """REF-15: ``running`` rows older than ``max_age_minutes`` (fixed default:
    120) become ``failed``."""
    stale = (F.col("status") == "running") & F.col("started_at").isNotNull() & (
        F.col("started_at") < F.lit(now - _dt.timedelta(minutes=max_age_minutes))
    )
    msg = f"no end recorded within {max_age_minutes} minutes"
    return runs.withColumns(
        {
            "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
            "error_message": F.when(stale, F.coalesce(F.col("error_message"), F.lit(msg))).otherwise(F.col("error_message")),
            "completed_at": F.when(stale, F.lit(now)).otherwise(F.col("completed_at")),
        }
    )


def latest_per_chart(runs: DataFrame) -> DataFrame:
    """WIN-4: the newest run per chart (largest run_id), as an aggregate."""
    cols = [c for c in runs.columns if c != "chart"]
    return runs.groupBy("chart").agg(F.max_by(F.struct(*cols), F.col("run_id")).alias("r")).select("chart", "r.*")


def freshness(runs: DataFrame, latest_days: DataFrame) -> DataFrame:
    """REF-16: per chart, latest cached day, last run status/time/rows, any running.

    ``latest_days`` has (chart, latest_day); charts without runs still appear.
    """
    last = latest_per_chart(runs).select(
        "chart",
        F.col("status").alias("last_status"),
        F.col("completed_at").alias("last_completed_at"),
        F.col("row_count").alias("last_row_count"),
    )
    running = runs.groupBy("chart").agg(F.max((F.col("status") == "running").cast("int")).cast("boolean").alias("any_running"))
    return (
        latest_days.join(last, "chart", "full_outer")
        .join(running, "chart", "left")
        .withColumn("any_running", F.coalesce(F.col("any_running"), F.lit(False)))
    )
