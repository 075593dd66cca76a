"""Progress of runs and their steps, read off an append log: (log, at, step, status, current, total, new_run).

A row without a step tells of the run. A run begins where one says `running` that asks for a new run or follows another
status; what steps of earlier runs said doesn't count. A step begins anew where it goes to `running` from another status
or is `skipped`, and forgets its counts. A log is one process's, so windows over it are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(log: DataFrame) -> DataFrame:
    """The log with the number of the run that each row belongs to, from 1; 0 before the first."""
    order = Window.partitionBy("log").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("step").isNull(), F.col("status")), ignorenulls=True).over(before)
    begins = F.col("step").isNull() & (F.col("status") == "running") & (F.coalesce("new_run", F.lit(False)) | F.coalesce(last != "running", F.lit(True)))
    return log.withColumn("run", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order))


def steps(log: DataFrame) -> DataFrame:
    """(log, step, status, current, total, percent) of the steps of each log's last run."""
    rows = runs(log)
    newest = rows.groupBy("log").agg(F.max("run").alias("run"))
    mine = rows.join(newest, ["log", "run"]).where(F.col("step").isNotNull())
    order = Window.partitionBy("log", "step").orderBy("at")
    last = F.last("status", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    anew = ((F.col("status") == "running") & F.coalesce(last != "running", F.lit(True))) | (F.col("status") == "skipped")
    aged = mine.withColumn("era", F.sum(F.coalesce(anew, F.lit(False)).cast("int")).over(order))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    told = aged.groupBy("log", "step", "era").agg(latest("status"), latest("current"), latest("total"))
    ended = aged.groupBy("log", "step").agg(F.max("era").alias("era"))
    share = F.when(F.col("status") == "completed", 100.0).when(F.col("total") > 0, F.round(F.col("current") * 100.0 / F.col("total"), 2))
    return told.join(ended, ["log", "step", "era"]).select("log", "step", F.coalesce("status", F.lit("pending")).alias("status"), "current", "total", share.alias("percent"))
