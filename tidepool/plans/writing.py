"""Scenes and summaries by a writer, a language model behind an interface, asked once for each prompt.

Answers stand in a table keyed by the prompt's hash. What is asked for is a table of prompts; an anti-join finds those
without an answer, Arrow batches ask for these on executors, and each answer or error is a row that is appended before
anything is made of it. So a run that stopped goes on with the prompts that are left, equal prompts are asked once, and a
second run asks nothing. Errors don't stop a run: their prompts are asked again by the next, up to TRIES times in all,
and fall back to the rules that need no writer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import summaries
from tidepool.functions.summaries import Writer
from tidepool.operators import segments
from tidepool.session import shared_folder

ANSWERS = "prompt_key string, answer string, error string"
#: Errors after which a prompt is left to the rules.
TRIES = 3


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


@dataclass
class Answers:
    """The table of answers at ``path``; ``make`` builds a writer, once for each task."""

    spark: SparkSession
    path: str
    make: Callable[[], Writer]

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(ANSWERS).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ANSWERS)

    def known(self) -> DataFrame:
        """(prompt_key, answer, tries): one row for each prompt that was asked; answer is NULL after errors alone."""
        return self.log().groupBy("prompt_key").agg(F.max("answer").alias("answer"), F.count("error").alias("tries"))

    def ask(self, prompts: DataFrame) -> int:
        """Asks for the answers of prompts (prompt) that aren't there yet; how many were asked."""
        shared_folder(self.spark)
        wanted = prompts.select("prompt").where(F.col("prompt").isNotNull()).select(prompt_key(F.col("prompt")).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
        done = self.known().where(F.col("answer").isNotNull() | (F.col("tries") >= TRIES))
        left = wanted.join(done, "prompt_key", "left_anti").checkpoint(eager=True)
        count, make = left.count(), self.make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            writer = make()
            for batch in batches:
                answers, errors = [], []
                for prompt in batch.column("prompt").to_pylist():
                    answer, error = None, None
                    try:
                        answer = writer.complete(prompt)
                    except Exception as fault:  # a service may fail in any way; its message is the row
                        error = f"{type(fault).__name__}: {fault}"
                    if answer is None and error is None:
                        error = "no answer"
                    answers.append(answer)
                    errors.append(error)
                yield pa.record_batch({"prompt_key": batch.column("prompt_key"), "answer": pa.array(answers, pa.string()), "error": pa.array(errors, pa.string())})

        if count:
            left.mapInArrow(run, ANSWERS).write.mode("append").parquet(self.path)
        return count

    def answered(self, rows: DataFrame, prompt: str = "prompt") -> DataFrame:
        """Rows with the answer to their prompt, NULL where there is none."""
        answers = self.known().select(F.col("prompt_key").alias("__key"), "answer")
        return rows.withColumn("__key", prompt_key(F.col(prompt))).join(answers, "__key", "left").drop("__key")


def windows(atoms: DataFrame) -> DataFrame:
    """(item_key, item_title, nth, n_windows, window, prompt) of items with atoms (idx, text, start_ms, end_ms) in order."""
    cut = F.transform(segments.windows(F.size("atoms")), lambda w: F.slice("atoms", w["start"] + 1, w["stop"] - w["start"]))
    rows = atoms.withColumn("__w", cut).withColumn("n_windows", F.size("__w"))
    rows = rows.select("item_key", "item_title", "n_windows", F.posexplode("__w").alias("nth", "window"))
    return rows.withColumn("prompt", summaries.boundary_prompt(F.col("item_title"), F.col("window")))


def voted_scenes(answers: Answers, atoms: DataFrame) -> tuple[DataFrame, int]:
    """(item_key, scenes): arrays of atom indexes, closed where windows' answers vote for it; and how many prompts were asked.

    A vote counts if it is an index of the window's atoms before its last. Without any answer scenes are made by rule.
    """
    cut = windows(atoms)
    asked = answers.ask(cut)
    said = answers.answered(cut)
    each = said.where("answer is not null").select("item_key", "n_windows", F.explode(F.array_distinct(summaries.boundaries(F.col("answer")))).alias("boundary"), "window")
    inside = (F.col("boundary") >= F.get("window", F.lit(0))["idx"]) & (F.col("boundary") < F.get("window", F.size("window") - 1)["idx"])
    votes = segments.boundary_votes(each.where(inside).select("item_key", "boundary", "n_windows"), F.col("n_windows"))
    by_item = votes.groupBy("item_key").agg(F.array_sort(F.collect_list(F.col("boundary").cast("int"))).alias("boundaries"))  # an item's atoms at most
    rows = atoms.join(by_item, "item_key", "left")
    return rows.select("item_key", segments.scenes(F.transform("atoms", lambda a: F.struct(a["idx"].alias("idx"), a["start_ms"].alias("start_ms"), a["end_ms"].alias("end_ms"))), F.col("boundaries")).alias("scenes")), asked


def summarised(answers: Answers, rows: DataFrame, prompt: Column, title: Column, fallback: Column) -> tuple[DataFrame, int]:
    """Rows with ``summary`` from the writer's answer to their prompt, or the fallback (a SUMMARY struct); prompts asked."""
    asked_rows = rows.withColumn("prompt", prompt)
    asked = answers.ask(asked_rows)
    said = answers.answered(asked_rows)
    own = summaries.sanitized(F.col("answer"), title)
    return said.withColumn("by_writer", own.isNotNull()).withColumn("summary", F.coalesce(own.cast(summaries.SUMMARY), fallback.cast(summaries.SUMMARY))).drop("prompt", "answer"), asked


def scene_summaries(answers: Answers, rows: DataFrame, allow_fallback: bool = True) -> tuple[DataFrame, int]:
    """rows: (item_key, scene, item_title, text, note_titles, words, tags)."""
    by_rule = summaries.fallback_scene(F.col("text"), F.col("note_titles"), F.col("words"), F.col("tags"), F.col("item_title"))
    title = F.concat(F.lit("片段 "), (F.col("scene") + 1).cast("string"))  # fixed value: a scene's name where the answer has none
    return summarised(answers, rows, summaries.scene_prompt(F.col("item_title"), F.col("text")), title, by_rule if allow_fallback else F.lit(None))


def episode_summaries(answers: Answers, rows: DataFrame, allow_fallback: bool = True) -> tuple[DataFrame, int]:
    """rows: (item_key, title, excerpt, desc, tags, scene_titles, scene_texts, note_titles)."""
    by_rule = summaries.fallback_episode(F.col("title"), F.col("excerpt"), F.col("desc"), F.col("tags"), F.col("scene_titles"), F.col("note_titles"))
    prompt = summaries.episode_prompt(F.col("title"), F.col("tags"), F.col("note_titles"), F.col("scene_titles"), F.col("scene_texts"))
    return summarised(answers, rows, prompt, F.coalesce("title", F.lit(summaries.CARD)), by_rule if allow_fallback else F.lit(None))
