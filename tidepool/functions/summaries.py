"""Summaries of scenes and episodes: prompts for a writer, its answers cleaned, and rules that need no writer."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.text import normalize, or_else, quoted_phrases
from tidepool.functions.web import json_object

SUMMARY = "struct<scene_title:string,summary:string,memory_clues:array<string>,entities:array<string>,aliases:array<string>,quoted_phrases:array<string>>"
LISTS = ("memory_clues", "entities", "aliases", "quoted_phrases")
#: Letters of a rule-based scene title and summary, and entries of its lists.
TITLE, BODY, CLUES, ENTITIES = 18, 280, 10, 8


class Writer(Protocol):
    """A language model that completes prompts; its answers may hold a JSON object among other words."""

    def complete(self, prompt: str) -> str: ...


def scene_prompt(title: Column, text: Column) -> Column:
    """What a writer is asked about a scene."""
    ask = "Summarise the scene below as one JSON object with the fields scene_title, summary, memory_clues, entities, aliases and quoted_phrases."
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Episode: "), F.coalesce(title, F.lit(""))), text)


def boundary_prompt(title: Column, atoms: Column) -> Column:
    """What a writer is asked about a window of atoms (idx, text): the indexes that end a scene."""
    listed = F.array_join(F.transform(atoms, lambda a: F.concat(a["idx"].cast("string"), F.lit(": "), a["text"])), "\n")
    return F.concat_ws("\n\n", F.lit('Which of the numbered segments end a scene? Answer with one JSON object {"boundaries": [numbers]}.'), F.concat(F.lit("Episode: "), F.coalesce(title, F.lit(""))), listed)


# What a card is called where its item has no title, and how many entries its parts have at most.
CARD = "节目记忆卡"
EPISODE_SCENES, EPISODE_NOTES, EPISODE_CLUES, EPISODE_ENTITIES, EPISODE_BODY = 24, 12, 12, 10, 400


def episode_prompt(title: Column, tags: Column, note_titles: Column, scene_titles: Column, scene_texts: Column) -> Column:
    """What a writer is asked about a whole episode: its first scenes and notes, its tags."""
    ask = "Write a memory card for the episode below as one JSON object with the fields scene_title, summary, memory_clues, entities, aliases and quoted_phrases. Invent nothing."
    none = F.array().cast("array<string>")
    listed = lambda name, values, most: F.concat(F.lit(f"{name}: "), F.array_join(F.slice(F.coalesce(values, none), 1, most), " / "))
    scenes = F.zip_with(F.slice(F.coalesce(scene_titles, none), 1, EPISODE_SCENES), F.slice(F.coalesce(scene_texts, none), 1, EPISODE_SCENES), lambda a, b: F.concat_ws("\n", a, b))
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Episode: "), F.coalesce(title, F.lit(""))), listed("Tags", tags, 1 << 20), listed("Notes", note_titles, EPISODE_NOTES), F.array_join(scenes, "\n\n"))


def fallback_episode(title: Column, excerpt: Column, desc: Column, tags: Column, scene_titles: Column, note_titles: Column) -> Column:
    """An episode's card by rule: its excerpt and description, or its first scenes' titles; tags, scenes and notes are its clues."""
    none = F.array().cast("array<string>")
    given = lambda values: F.filter(F.coalesce(values, none), lambda t: F.coalesce(t, F.lit("")) != "")
    told = F.array_distinct(F.concat(F.coalesce(tags, none), F.slice(given(scene_titles), 1, 8), F.slice(given(note_titles), 1, 8)))
    clues = F.filter(told, lambda t: F.coalesce(t, F.lit("")) != "")
    own = F.substring(F.array_join(given(F.array(excerpt, desc)), "；"), 1, EPISODE_BODY)
    body = F.when(own != "", own).otherwise(F.substring(F.array_join(F.slice(given(scene_titles), 1, 5), "；"), 1, EPISODE_BODY))
    return F.struct(or_else(title, F.lit(CARD)).alias("scene_title"), body.alias("summary"), F.slice(clues, 1, EPISODE_CLUES).alias("memory_clues"), F.slice(clues, 1, EPISODE_ENTITIES).alias("entities"), none.alias("aliases"), F.coalesce(quoted_phrases(body), none).alias("quoted_phrases"))


def boundaries(answer: Column) -> Column:
    """The indexes of a writer's answer; empty for none."""
    return F.coalesce(F.from_json(F.get_json_object(json_object(answer), "$.boundaries"), "array<int>"), F.array().cast("array<int>"))


def clean_list(values: Column) -> Column:
    """Normalised texts, distinct, none empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize), lambda t: t != ""))


def sanitized(answer: Column, fallback_title: Column) -> Column:
    """A writer's answer as SUMMARY; fields that are missing or of another kind are empty. NULL where it holds no object."""
    found = json_object(answer)
    field = lambda name: F.get_json_object(found, f"$.{name}")
    title = F.coalesce(F.nullif(F.trim(field("scene_title")), F.lit("")), F.trim(fallback_title))
    lists = [clean_list(F.from_json(field(name), "array<string>")).alias(name) for name in LISTS]
    return F.when(found.isNotNull(), F.struct(title.alias("scene_title"), F.trim(F.coalesce(field("summary"), F.lit(""))).alias("summary"), *lists))


def fallback_scene(text: Column, note_titles: Column, words: Column, tags: Column, item_title: Column, generic: Column | None = None) -> Column:
    """A scene's summary by rule: notes, the first index words of its text and tags are its clues, the first that isn't generic its title."""
    none = F.array().cast("array<string>")
    clues = F.array_distinct(F.filter(F.concat(F.coalesce(note_titles, none), F.slice(F.coalesce(words, none), 1, CLUES), F.coalesce(tags, none)), lambda t: F.coalesce(t, F.lit("")) != ""))
    told = clues if generic is None else F.filter(clues, lambda t: ~F.array_contains(generic, t))
    raw = F.trim(F.coalesce(text, F.lit("")))
    # What stands for a title where there is none.
    title = F.coalesce(F.get(told, F.lit(0)), F.nullif(F.substring(raw, 1, TITLE), F.lit("")), F.concat(or_else(item_title, F.lit("节目")), F.lit("片段")))
    return F.struct(title.alias("scene_title"), F.substring(raw, 1, BODY).alias("summary"), F.slice(clues, 1, CLUES).alias("memory_clues"), F.slice(clues, 1, ENTITIES).alias("entities"), none.alias("aliases"), F.coalesce(quoted_phrases(raw), none).alias("quoted_phrases"))
