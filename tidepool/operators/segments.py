"""Segmentation of timed transcripts: atoms, windows and scenes. Folds run over arrays; rows keep their item's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import has_anchor, is_low_signal, normalize

SEGMENT = "struct<start_ms:bigint,end_ms:bigint,text:string,speaker_id:string>"


def parse_segments(segments: Column) -> Column:
    """Cleaned segments of a JSON array: text normalised, low-signal ones dropped, ends not before starts; NULL-safe."""
    raw = F.from_json(segments, "array<struct<start_ms:string,end_ms:string,start_time:string,end_time:string,text:string,speaker_id:string,lang:string,language:string,asr_confidence:double>>")
    ms = lambda *c: F.coalesce(*[F.nullif(x.try_cast("double").cast("bigint"), F.lit(0)) for x in c])

    def one(s: Column, i: Column) -> Column:
        start = F.coalesce(ms(s["start_ms"], s["start_time"]), F.lit(0))
        end = F.coalesce(ms(s["end_ms"], s["end_time"]), start)
        return F.struct(
            i.alias("segment_index"), start.alias("start_ms"), F.greatest(start, end).alias("end_ms"), normalize(s["text"]).alias("text"),
            s["speaker_id"].alias("speaker_id"), F.coalesce(s["lang"], s["language"]).alias("language"), s["asr_confidence"].alias("asr_confidence"),
        )

    kept = F.filter(F.transform(raw, one), lambda s: ~is_low_signal(s["text"]))
    return F.coalesce(kept, F.array().cast("array<struct<segment_index:int,start_ms:bigint,end_ms:bigint,text:string,speaker_id:string,language:string,asr_confidence:double>>"))


def atoms_of(segments: Column, target: int = 25_000, hard: int = 30_000) -> Column:
    """Array of atoms, each an array of consecutive segments (start_ms, end_ms, text, speaker_id)."""
    empty = F.array().cast(f"array<{SEGMENT}>")
    zero = F.struct(F.array().cast(f"array<array<{SEGMENT}>>").alias("done"), empty.alias("open"))

    def merge(acc: Column, s: Column) -> Column:
        first, last = F.get(acc["open"], F.lit(0)), F.element_at(acc["open"], -1)
        so_far = last["end_ms"] - first["start_ms"]
        close = (F.size(acc["open"]) > 0) & (
            ((s["end_ms"] - first["start_ms"] > target) & (so_far >= 12_000))
            | (has_anchor(last["text"]) & (so_far >= 8_000))
            | (has_anchor(s["text"]) & (so_far >= 10_000))
            | (F.coalesce((F.coalesce(last["speaker_id"], F.lit("")) != "") & (F.coalesce(s["speaker_id"], F.lit("")) != "") & (last["speaker_id"] != s["speaker_id"]), F.lit(False)) & (so_far >= 12_000))
        )
        done = F.when(close, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        now = F.when(close, F.array(s)).otherwise(F.concat(acc["open"], F.array(s)))
        full = s["end_ms"] - F.get(now, F.lit(0))["start_ms"] >= hard
        return F.when(full, F.struct(F.concat(done, F.array(now)).alias("done"), empty.alias("open"))).otherwise(F.struct(done.alias("done"), now.alias("open")))

    finish = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    # element_at fails on an empty array, so an empty open list has a stand-in that no rule reads.
    return F.aggregate(segments, zero, lambda acc, s: F.when(F.size(acc["open"]) == 0, _opened(acc, s, hard, empty)).otherwise(merge(acc, s)), finish)


def _opened(acc: Column, s: Column, hard: int, empty: Column) -> Column:
    full = s["end_ms"] - s["start_ms"] >= hard
    return F.when(full, F.struct(F.concat(acc["done"], F.array(F.array(s))).alias("done"), empty.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.array(s).alias("open")))


def atom_rows(items: DataFrame, segments: str = "segments", key: str = "item_key") -> DataFrame:
    """(key, doc_index, start_ms, end_ms, text, n_segments): a row for each atom."""
    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["text"].alias("text"), s["speaker_id"].alias("speaker_id"))))
    rows = items.select(key, F.posexplode(atoms_of(ordered)).alias("doc_index", "a"))
    return rows.select(
        key, "doc_index", F.col("a")[0]["start_ms"].alias("start_ms"), F.array_max(F.transform("a", lambda s: s["end_ms"])).alias("end_ms"),
        F.array_join(F.transform("a", lambda s: s["text"]), " ").alias("text"), F.size("a").alias("n_segments"),
    )


def windows(n: Column, size: int = 14, overlap: int = 3) -> Column:
    """(start, stop) of overlapping windows over n places, up to the first that reaches the end."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("stop")))
    # A window begins only if the one before it was whole.
    return F.when(n > 0, F.filter(cut, lambda w: (w["start"] == 0) | (w["start"] + overlap < n))).otherwise(F.slice(cut, 1, 0))


GROUP = "struct<start_ms:bigint,end_ms:bigint,ids:array<int>>"
SCENE_MIN, SCENE_MAX = 45_000, 300_000


def _group(start: Column, end: Column, ids: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), ids.alias("ids"))


def _span(g: Column) -> Column:
    return g["end_ms"] - g["start_ms"]


def _appended(open_: Column, a: Column) -> Column:
    return F.when(open_.isNull(), _group(a["start_ms"], a["end_ms"], F.array(a["idx"]))).otherwise(_group(open_["start_ms"], a["end_ms"], F.concat(open_["ids"], F.array(a["idx"]))))


def _folded(atoms: Column, step, finish) -> Column:
    """Folds atoms into (done, open) by step, then finishes."""
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    zero = state(F.array().cast(f"array<{GROUP}>"), F.lit(None).cast(GROUP))
    return F.aggregate(atoms, zero, lambda acc, a: step(acc["done"], acc["open"], a, state), lambda acc: finish(acc["done"], acc["open"]))


def _closed(done: Column, g: Column) -> Column:
    return F.concat(done, F.array(g))


def _flush(done: Column, open_: Column) -> Column:
    return F.when(open_.isNull(), done).otherwise(_closed(done, open_))


def fallback_groups(atoms: Column, most: int = 8, long: int = 180_000, tail: int = 4) -> Column:
    """Groups closed at 8 atoms or three minutes; a short tail joins the group before it."""
    none = F.lit(None).cast(GROUP)

    def step(done, open_, a, state):
        now = _appended(open_, a)
        return F.when((F.size(now["ids"]) >= most) | (_span(now) >= long), state(_closed(done, now), none)).otherwise(state(done, now))

    def finish(done, open_):
        last = F.get(done, F.size(done) - 1)
        joined = _group(last["start_ms"], open_["end_ms"], F.concat(last["ids"], open_["ids"]))
        short = open_.isNotNull() & (F.size(done) > 0) & (F.size(open_["ids"]) < tail)
        return F.when(short, _closed(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), joined)).otherwise(_flush(done, open_))

    return _folded(atoms, step, finish)


def boundary_groups(atoms: Column, boundaries: Column) -> Column:
    """Groups closed behind a boundary atom if long enough, or when full; an atom that overfills opens the next group."""
    none = F.lit(None).cast(GROUP)

    def settle(done, now, a, state):
        ends = (F.array_contains(boundaries, a["idx"]) & (_span(now) >= SCENE_MIN)) | (_span(now) >= SCENE_MAX)
        return F.when(ends, state(_closed(done, now), none)).otherwise(state(done, now))

    def step(done, open_, a, state):
        now = _appended(open_, a)
        alone = _group(a["start_ms"], a["end_ms"], F.array(a["idx"]))
        over = (_span(now) > SCENE_MAX) & open_.isNotNull()
        return F.when(over, settle(_closed(done, open_), alone, a, state)).otherwise(settle(done, now, a, state))

    return _folded(atoms, step, _flush)


def merged_groups(groups: Column) -> Column:
    """Groups below 45 s join the one before, where both stay within five minutes."""

    def step(acc: Column, g: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = _group(last["start_ms"], g["end_ms"], F.concat(last["ids"], g["ids"]))
        joins = (F.size(acc) > 0) & (_span(g) < SCENE_MIN) & (_span(both) <= SCENE_MAX)
        return F.when(F.coalesce(joins, F.lit(False)), _closed(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), both)).otherwise(_closed(acc, g))

    return F.aggregate(groups, F.array().cast(f"array<{GROUP}>"), step)


def are_valid(groups: Column) -> Column:
    """None above five minutes; only the first and the last below 45 s. Order and completeness hold by construction."""
    inner = F.slice(groups, 2, F.greatest(F.lit(0), F.size(groups) - 2))
    return F.forall(groups, lambda g: _span(g) <= SCENE_MAX) & F.forall(inner, lambda g: _span(g) >= SCENE_MIN)


def fallback_scenes(atoms: Column) -> Column:
    """Arrays of atom indexes by counts and lengths alone; one group of all where that gives none that is valid.

    ``atoms`` is an array of (idx, start_ms, end_ms) in order.
    """
    groups = merged_groups(fallback_groups(atoms))
    whole = F.array(F.transform(atoms, lambda a: a["idx"]))
    return F.when(F.size(atoms) == 0, F.array().cast("array<array<int>>")).when(are_valid(groups), F.transform(groups, lambda g: g["ids"])).otherwise(whole)


def scenes(atoms: Column, boundaries: Column) -> Column:
    """Arrays of atom indexes by boundaries; by ``fallback_scenes`` where there are none or they give no valid groups."""
    groups = merged_groups(boundary_groups(atoms, boundaries))
    use = (F.size(F.coalesce(boundaries, F.array().cast("array<int>"))) > 0) & (F.size(groups) > 0) & are_valid(groups)
    return F.when(use, F.transform(groups, lambda g: g["ids"])).otherwise(fallback_scenes(atoms))


def boundary_votes(votes: DataFrame, n_windows: Column, key: str = "item_key") -> DataFrame:
    """(key, boundary, votes): boundaries with two votes (one, of a single window); all voted ones where none has."""
    counted = votes.groupBy(key, "boundary").agg(F.count("*").alias("votes"), F.max(n_windows).alias("n_windows"))
    enough = F.col("votes") >= F.when(F.col("n_windows") <= 1, 1).otherwise(2)
    any_enough = counted.groupBy(key).agg(F.max(enough.cast("int")).alias("some"))
    return counted.join(any_enough, key).where(enough | (F.col("some") == 0)).select(key, "boundary", "votes")


def shifted(payloads: Column) -> Column:
    """One payload (text, segments, words, model_name, language, chunk_count) of chunk payloads with offset_ms, in order."""
    late = lambda xs, by: F.transform(xs, lambda s: s.withField("start_ms", s["start_ms"] + by).withField("end_ms", s["end_ms"] + by))
    moved = lambda name: F.flatten(F.filter(F.transform(payloads, lambda p: late(p[name], p["offset_ms"])), lambda xs: xs.isNotNull()))
    first = lambda name: F.get(F.filter(F.transform(payloads, lambda p: p[name]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    texts = F.filter(F.transform(payloads, lambda p: F.trim(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
    return F.struct(
        F.array_join(texts, "\n").alias("text"), moved("segments").alias("segments"), moved("words").alias("words"),
        first("model_name").alias("model_name"), first("language").alias("language"), F.size(payloads).alias("chunk_count"),
    )


def first_bound(u: Column, *names: str) -> Column:
    """The first of several fields of an utterance that is neither NULL nor zero, in whole milliseconds."""
    return F.coalesce(*[F.nullif(u[n].try_cast("double").cast("bigint"), F.lit(0)) for n in names])


def remote_segment(u: Column, starts: tuple[str, ...] = ("start_time",), ends: tuple[str, ...] = ("end_time", "stop_time")) -> Column:
    """A remote recogniser's utterance (with a map ``additions``) as a segment."""
    said = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(u["additions"], F.lit(n)), F.lit("")) for n in names])
    return F.struct(
        first_bound(u, *starts).alias("start_ms"), first_bound(u, *ends).alias("end_ms"), u["text"].alias("text"), said("speaker_id", "speaker").alias("speaker_id"),
        said("lid_lang").alias("language"), said("emotion").alias("emotion"), said("gender").alias("gender"), said("volume").alias("volume"), said("speech_rate").alias("speech_rate"),
    )


def remote_words(utterances: Column) -> Column:
    """Words of all utterances with the index of theirs."""
    one = lambda i, w: F.struct(i.alias("segment_index"), w["start_time"].alias("start_ms"), w["end_time"].alias("end_ms"), w["text"].alias("text"))
    return F.flatten(F.filter(F.transform(utterances, lambda u, i: F.transform(u["words"], lambda w: one(i, w))), lambda ws: ws.isNotNull()))


def aliased(text: Column, segments: Column, aliases: dict[str, str]) -> tuple[Column, Column, dict[str, Column]]:
    """Text and segments with aliases replaced, and for each `from->to` how often in all."""
    from tidepool.functions.text import replace_aliases

    whole, counts = replace_aliases(text, aliases)
    parts = F.transform(segments, lambda s: s.withField("text", replace_aliases(s["text"], aliases)[0]))
    inside = lambda name: F.aggregate(segments, F.lit(0), lambda acc, s: acc + F.coalesce(replace_aliases(s["text"], aliases)[1][name], F.lit(0)))
    return whole, parts, {name: c + inside(name) for name, c in counts.items()}


def repaired(rows: DataFrame, segments: str = "segments", text: str = "text") -> DataFrame:
    """Adds cleaned segments, their text, and why a repair is refused (NULL if it is not)."""
    from tidepool.functions.text import drop_segment, repetition_reason

    n = F.size(segments)
    kept = F.filter(segments, lambda s, i: ~drop_segment(F.trim(s["text"]), i, n, s["asr_confidence"]))
    clean = F.array_join(F.transform("cleaned", lambda s: F.trim(s["text"])), "\n")
    out = rows.withColumn("cleaned", kept).withColumn("cleaned_text", clean)
    refused = (
        F.when(F.coalesce(F.size(segments), F.lit(0)) < 1, "no segments")
        .when(F.size("cleaned") == F.size(segments), "nothing removed")
        .when(F.col("cleaned_text") == "", "empty")
        .when(repetition_reason(F.col("cleaned_text")).isNotNull(), "still repeated")
        .when(F.length("cleaned_text") < F.greatest(F.lit(1000), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) * 0.5)), "shrank too much")
    )
    return out.withColumn("refused", refused)
