"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a transition or a structural point of a transcript.
TRANSITIONS = ("接下来", "另外一个", "另外一条", "再说回", "下面聊", "下一条", "下一条新闻", "最后一个", "然后再", "说回", "再聊聊")
STRUCTURAL = ("欢迎收听", "欢迎回来", "感谢收听", "下期再见", "广告之后", "片头", "片尾")
# Fixed value: a run of laughter that marks a segment as empty.
LAUGHTER = "哈" * 14

BLANK = r"(?U)[\s\x{001c}-\x{001f}]+"


def or_else(*columns: Column | str) -> Column:
    """First column that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def normalize(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))


def normalize_lines(text: Column) -> Column:
    """Lines stripped, blank lines dropped, CRLF as LF."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    stripped = F.transform(lines, lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda line: line != ""), "\n")


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else untouched: the case rule of a LIKE that folds ASCII only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_literal(term: str) -> str:
    """The term as a LIKE pattern's literal part, with backslash as escape."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def folded(term: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in term)


def folds_plainly(term: str) -> bool:
    """Whether a term is found alike in text that is lower-cased as a whole: no cased letters beyond ASCII."""
    return not any(c > "\x7f" and c.lower() != c.upper() for c in term) and "\u0307" not in term and "\x01" not in term


def lowered(text: Column) -> Column:
    """The whole text in lower case, the two characters whose lower case holds an ASCII letter out of the way."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\x01")), F.lit("\u0130"), F.lit("\x01")))


def contains_term(text: Column, term: str) -> Column:
    """LIKE '%term%' with wildcards escaped and ASCII case folded; substring search needs no pattern.

    Lower-casing the whole text is much faster than folding A-Z alone and finds the same for most terms.
    """
    return F.contains(lowered(text) if folds_plainly(term) else fold_ascii(F.coalesce(text, F.lit(""))), F.lit(folded(term)))


def quoted_phrases(text: Column) -> Column:
    """Distinct phrases of 2 to 32 characters in curly or straight double quotes, in order."""
    hit = F.regexp_extract_all(text, F.lit(r"“([^”]{2,32})”|\"([^\"]{2,32})\""), F.lit(0))
    bare = F.transform(hit, lambda p: normalize(F.substring(p, F.lit(2), F.length(p) - 2)))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


def has_anchor(text: Column) -> Column:
    """Whether a transition or structural phrase stands in the text."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("|".join((*TRANSITIONS, *STRUCTURAL))))


def is_low_signal(text: Column) -> Column:
    """Empty, a character 12 times in a row, a run of laughter, or at most 24 characters without a letter or digit."""
    # The lengths of runs.
    clean = normalize(text)
    return (clean == "") | F.rlike(clean, F.lit(r"(.)\1{11,}")) | F.contains(clean, F.lit(LAUGHTER)) | ((F.regexp_replace(clean, r"(?U)[\W_]+", "") == "") & (F.length(clean) <= 24))


def quality_flags(text: Column) -> Column:
    """Array of empty, repeated_chars, short, laughter_run, in this order."""
    clean = normalize(text)
    flags = F.array(
        F.when(clean == "", F.lit("empty")),
        F.when(F.rlike(clean, F.lit(r"(.)\1{11,}")), F.lit("repeated_chars")),
        F.when(F.length(clean) < 20, F.lit("short")),
        F.when(F.contains(clean, F.lit(LAUGHTER)), F.lit("laughter_run")),
    )
    return F.array_compact(flags)


def unique_char_ratio(text: Column) -> Column:
    """Distinct characters over all, white space left out, letters lower-cased; NULL for an empty text."""
    compact = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK, "")
    return F.try_divide(F.size(F.array_distinct(F.filter(F.split(compact, ""), lambda c: c != ""))).cast("double"), F.length(compact))


def top_token_ratio(text: Column) -> Column:
    """Share of the most frequent token among all tokens; 0 for none."""
    tokens = F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w\x{4e00}-\x{9fff}]+"), F.lit(0)))
    # Equal tokens stand together once sorted: the longest run is the highest count.
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def merge(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.coalesce(F.try_divide(F.aggregate(tokens, zero, merge, lambda acc: acc["best"]).cast("double"), F.size(tokens)), F.lit(0.0))


def repetition_reason(text: Column) -> Column:
    """Why a transcript looks repeated: empty, low_unique_ratio, char_run, token_ratio; NULL if it doesn't."""
    compact = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK, "")
    tokens = F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w\x{4e00}-\x{9fff}]+"), F.lit(0)))
    long = F.length(compact) >= 180
    return (
        F.when(compact == "", F.lit("empty"))
        .when(long & (unique_char_ratio(text) < 0.02), F.lit("low_unique_ratio"))
        .when(long & F.rlike(compact, F.lit(r"(?s)(.)\1{23,}")), F.lit("char_run"))
        .when((tokens >= 40) & (top_token_ratio(text) > 0.45), F.lit("token_ratio"))
    )


def letter_grams(word: Column, sizes: Sequence[int]) -> Column:
    """All parts of a word of the given lengths, in order of length and place."""
    cut = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[cut(n) for n in sizes])


def sentence_units(text: Column) -> Column:
    """Stripped non-empty units: paragraphs, cut after sentence ends."""
    paragraphs = F.split(normalize_lines(text), r"\n+")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "(?<=[。！？!?；;])")))
    return F.filter(F.transform(cut, lambda u: F.regexp_replace(u, r"(?U)^\s+|\s+$", "")), lambda u: u != "")


def hard_wrap(text: Column, width: int) -> Column:
    """Slices of fixed width, trimmed, blank ones dropped."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / F.lit(width)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(text, i * width + 1, F.lit(width))))
    return F.filter(cut, lambda s: s != "")


def pack_chunks(units: Column, width: int) -> Column:
    """Units joined by newlines as long as they fit the width; a longer unit closes the chunk and is wrapped."""
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def merge(acc: Column, unit: Column) -> Column:
        joined = F.when(acc["open"] == "", unit).otherwise(F.concat(acc["open"], F.lit("\n"), unit))
        return (
            F.when(F.length(unit) > width, F.struct(F.concat(closed(acc), hard_wrap(unit, width)).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) <= width, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(closed(acc).alias("done"), unit.alias("open")))
        )

    return F.aggregate(units, zero, merge, closed)


def text_chunks(text: Column, width: int = 800) -> Column:
    return pack_chunks(sentence_units(text), width)


def segment_chunks(header: Sequence[Column], body: Sequence[Column], width: int = 800) -> Column:
    """Texts of a segment's documents: its header above each chunk of its body; the header alone if there is no body."""
    distinct = lambda parts: F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != ""))
    head, text = F.array_join(distinct(header), "\n"), F.array_join(distinct(body), "\n\n")
    budget = F.when(head == "", F.lit(width)).otherwise(F.greatest(F.lit(200), F.lit(width) - F.length(head) - 2))
    units = sentence_units(text)
    empty = F.array().cast("array<string>")

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def wrapped(unit: Column) -> Column:
        last = F.floor((F.length(unit) - 1) / budget).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(unit, (i * budget + 1).cast("int"), budget))), lambda s: s != "")

    def merge(acc: Column, unit: Column) -> Column:
        joined = F.when(acc["open"] == "", unit).otherwise(F.concat(acc["open"], F.lit("\n"), unit))
        return (
            F.when(F.length(unit) > budget, F.struct(F.concat(closed(acc), wrapped(unit)).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) <= budget, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(closed(acc).alias("done"), unit.alias("open")))
        )

    chunks = F.aggregate(units, F.struct(empty.alias("done"), F.lit("").alias("open")), merge, closed)
    headed = F.when(head == "", chunks).otherwise(F.transform(chunks, lambda c: F.concat(head, F.lit("\n\n"), c)))
    return F.when(F.size(chunks) > 0, headed).when(head != "", F.array(head)).otherwise(empty)


def excerpt(text: Column, terms: Column, width: int = 180, head: Column | None = None) -> Column:
    """Snippet around the first term that the text holds; where none does, the text's head if ``head`` is true."""

    def cut(clean: Column) -> Column:
        hit = F.filter(terms, lambda t: F.contains(clean, t))
        index = F.call_function("instr", clean, F.get(hit, F.lit(0))) - 1
        start = F.greatest(F.lit(0), index - width // 3)
        end = F.least(F.length(clean), index + width)
        snippet = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.trim(F.substring(clean, start + 1, end - start)), F.when(end < F.length(clean), F.lit("...")).otherwise(F.lit("")))
        lead = F.when(F.length(clean) <= width, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, width)), F.lit("...")))
        fallback = F.lit(None).cast("string") if head is None else F.when(head, lead)
        return F.when(clean == "", F.lit(None)).when(F.size(hit) > 0, snippet).otherwise(fallback)

    return F.get(F.transform(F.array(normalize(text)), cut), F.lit(0))  # an element of an array is worked out once


def format_ms(ms: Column) -> Column:
    """HH:MM:SS, or MM:SS below an hour; negative counts as zero."""
    total = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000).cast("int")
    hours, minutes, seconds = F.floor(total / 3600).cast("int"), F.floor(total % 3600 / 60).cast("int"), total % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%02d:%02d", minutes, seconds))


def replace_aliases(text: Column, aliases: dict[str, str]) -> tuple[Column, dict[str, Column]]:
    """Text with aliases replaced, longest first, and for each `from->to` how often."""
    counts = {}
    for src, dst in sorted(aliases.items(), key=lambda p: -len(p[0])):
        counts[f"{src}->{dst}"] = ((F.length(text) - F.length(F.replace(text, F.lit(src), F.lit("")))) / len(src)).cast("int")
        text = F.replace(text, F.lit(src), F.lit(dst))
    return text, counts


def classify_error(message: Column) -> Column:
    """bad_allocation, cuda_error, hallucinated_repeat_token, empty_output or other."""
    low = F.trim(F.lower(F.coalesce(message, F.lit(""))))
    return (
        F.when(F.startswith(low, F.lit("bad allocation")), "bad_allocation")
        .when(F.contains(low, F.lit("cuda error")) | F.contains(low, F.lit("illegal memory access")), "cuda_error")
        .when(F.rlike(low, F.lit(r"^[a-z]/\('.*',\s*[\d.]+,\s*[\d.]+\)$")), "hallucinated_repeat_token")
        .when(F.contains(low, F.lit("did not contain text")), "empty_output")
        .otherwise("other")
    )


def rescue_plan(category: Column, seconds: Column) -> Column:
    """Strategy, chunk and overlap seconds, resets and priority of a second transcription attempt."""
    seconds = F.coalesce(seconds.cast("double"), F.lit(0.0))

    # Fixed values below: seconds and priorities of the plans.
    def plan(strategy: Column | str, chunk: int, overlap: int, before: bool, each: bool, priority: int) -> Column:
        how = F.lit(strategy) if isinstance(strategy, str) else strategy
        return F.struct(how.alias("strategy"), F.lit(chunk).alias("chunk_seconds"), F.lit(overlap).alias("overlap_seconds"), F.lit(before).alias("reset_before"), F.lit(each).alias("reset_each_chunk"), F.lit(priority).alias("priority"))

    return (
        F.when(category == "bad_allocation", plan("chunked", 1500, 3, False, False, 0))
        .when(category == "hallucinated_repeat_token", plan(F.when(seconds >= 1800, "chunked").otherwise("isolated"), 300, 2, False, True, 1))
        .when(category == "cuda_error", plan("isolated", 0, 0, True, False, 2))
        .when(seconds >= 3600, plan("chunked", 1500, 3, False, False, 1))
        .otherwise(plan("isolated", 0, 0, False, False, 3))
    )


def is_recoverable(message: Column) -> Column:
    """Errors after which a fresh runner may do better."""
    # What such messages hold.
    return F.rlike(F.lower(F.coalesce(message, F.lit(""))), F.lit("illegal memory access|cuda error|device-side assert|cublas|out of memory|misaligned address"))


# What messages of services hold that may answer later, and of tables that are busy.
LATER = ("429", "rate limit", "too many requests", "timeout", "timed out", "connection reset", "temporary", "temporarily", "503", "502", "504", "service unavailable", "upstream", "quota")
BUSY = ("readonly", "locked", "busy")


def may_pass(message: Column, busy: bool = False) -> Column:
    """Errors of a search service that a later try may not meet; with ``busy`` those of a table that others write, too."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*[F.lit(t) for t in (LATER + BUSY if busy else LATER)]), lambda t: F.contains(low, t))


def guess_extension(url: Column, access: Column, media: Column) -> Column:
    suffix = F.lower(F.regexp_extract(F.coalesce(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("")), r"[^/](\.[^./]+)$", 1))
    return (
        F.when(access == "play_auth", ".json")
        .when((suffix != "") & (suffix != ".m3u8") & (F.length(suffix) <= 8), suffix)
        .when(access.isin("m3u8", "playlist_url"), F.when(media.isin("taptap", "vod"), ".mp4").otherwise(".media"))
        .when(media == "speech", ".mp3")
        .when(access == "asset_url", ".asset")
        .when(access.isin("audio_url", "original_src"), ".mp3")
        .otherwise(".bin")
    )


def media_source(audio_url: Column, media_type: Column, provider: Column, m3u8: Column, play_auth: Column, original_src: Column, playlist_url: Column) -> Column:
    """The first source that a medium has, by priority; NULL if none."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    none = F.lit(None).cast("string")

    def source(provider: str, access: str, url: Column, auth: Column, method: str) -> Column:
        return F.struct(F.lit(provider).alias("provider"), F.lit(access).alias("access_mode"), url.alias("media_url"), auth.alias("play_auth"), F.lit(method).alias("download_method"))

    return (
        F.when(given(audio_url), source("direct", "audio_url", audio_url, none, "direct"))
        .when(media_type == "protected_audio", F.lit(None))
        .when((provider == "taptap") & given(m3u8), source("taptap", "m3u8", m3u8, none, "ffmpeg"))
        .when((provider == "vod") & given(play_auth), source("vod", "play_auth", none, play_auth, "provider_api"))
        .when(given(original_src), source("direct", "original_src", original_src, none, "direct"))
        .when(given(playlist_url), source("playlist", "playlist_url", playlist_url, none, "ffmpeg"))
    )


def stitch(parts: Column, most: int = 80) -> Column:
    """Chunk texts joined, each without what its start repeats of the end before, up to ``most`` characters."""

    def merge(acc: Column, part: Column) -> Column:
        clean = F.trim(part)
        sizes = F.sequence(F.lit(most), F.lit(1), F.lit(-1))
        # Of a long text only its end is compared, and cut off once.
        fits = lambda end: F.filter(sizes, lambda n: (n <= F.length(end)) & (n <= F.length(clean)) & (F.right(end, n) == F.left(clean, n)))
        held = F.get(F.transform(F.array(F.right(acc, F.lit(most))), lambda end: F.coalesce(F.get(fits(end), F.lit(0)), F.lit(0))), F.lit(0))
        return F.when(acc == "", clean).when(clean == "", acc).otherwise(F.concat(acc, F.substring(clean, held + 1, F.length(clean))))

    return F.aggregate(parts, F.lit(""), merge)


def drop_segment(text: Column, index: Column, total: Column, confidence: Column) -> Column:
    """Whether repair drops a segment: noise at either end, unknown tokens, long runs, repeated tokens."""
    low = F.lower(text)
    edge = (index < 24) | (index >= F.greatest(F.lit(0), total - 24))
    tokens = F.size(F.regexp_extract_all(low, F.lit(r"(?U)[\w\x{4e00}-\x{9fff}]+"), F.lit(0)))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    cjk = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    # Words of background music that recognisers put at the ends.
    noise = r"(?U)\b(da|na|yeah|baby|move|club|yoga|touch|nobody|know|bae|oh|trip|monday|fasaka)\b"
    return (
        (F.coalesce(text, F.lit("")) == "")
        | F.contains(low, F.lit("<unk>"))
        | F.rlike(F.regexp_replace(low, BLANK, ""), F.lit(r"(?s)(.)\1{19,}"))
        | ((tokens >= 8) & (top_token_ratio(text) > 0.6))
        | (edge & F.rlike(low, F.lit(noise)))
        | (edge & (latin >= 16) & (latin > cjk * 2) & (F.coalesce(confidence, F.lit(1.0)) < 0.9))
    )
