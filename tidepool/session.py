"""Session settings that results depend on, and those that keep plans adaptive."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tidepool", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names have underscores where settings have dots."""
    chosen = SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(app).config(map=chosen).getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where a small table comes in fewer splits; larger ones are left as they are.

    A file of one row group is one task otherwise, however costly the work on each row is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A local master may do without one, as in tests, and gets a folder of its own; on a cluster that would be a folder
    that other machines don't see, so it is an error there.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()
