"""Replacement of media addresses that no longer work: the medium's id is read off, a resolver asked, jobs given the answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.web import media_id, with_suffix_of

#: Addresses of media by id, None where there is none; runs on executors, a batch at a time.
Resolver = Callable[[Sequence[str]], Sequence[str | None]]


def replacements(jobs: DataFrame, pattern: str, resolve: Resolver) -> DataFrame:
    """(job_id, media_url, new_url, new_relpath, reason): what a replacement would do to each job whose address fits the pattern.

    A resolver that fails leaves the batch's jobs without a new address and says why.
    """
    asked = jobs.select("job_id", "media_url", "local_relpath", media_id(F.col("media_url"), pattern).alias("medium")).where(F.col("medium").isNotNull())
    kind = asked.schema["job_id"].dataType.simpleString()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found, why = list(resolve(batch["medium"].tolist())), None
            except Exception as error:  # a service's failure is a result here
                found, why = [None] * len(batch), str(error)[:300]
            reasons = [why or (None if x else "not found") for x in found]
            yield batch[["job_id", "media_url", "local_relpath"]].assign(new_url=pd.Series(found, dtype=object).values, reason=pd.Series(reasons, dtype=object).values)

    told = asked.mapInPandas(answer, f"job_id {kind}, media_url string, local_relpath string, new_url string, reason string")
    relpath = F.when(F.col("new_url").isNotNull(), with_suffix_of(F.col("local_relpath"), F.col("new_url")))
    return told.select("job_id", "media_url", "new_url", relpath.alias("new_relpath"), "reason")


def replaced(jobs: DataFrame, found: DataFrame, at: str, provider: str = "direct") -> DataFrame:
    """Jobs that start anew from their replacements; the others as they are."""
    from tidepool.operators.states import resourced

    new = found.where(F.col("new_url").isNotNull()).select(
        "job_id", F.col("new_url").alias("media_url"), F.col("new_relpath").alias("local_relpath"), F.lit(provider).alias("provider"), F.lit("audio_url").alias("access_mode"),
        F.lit("direct").alias("download_method"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("last_error"),
    )
    return resourced(jobs, new, at)
