"""Personal data: fixed patterns as seeds, and identifiers found from the contexts that seeds stand in.

Emails, IP addresses, payment cards and phone numbers are found by pattern and check, and secrets by what they are
assigned to (`token = "..."`). They seed a graph of instances (seeds, and identifier-like strings) and lexical patterns:
two or three words before, one word before with one after, and one before that ends in a mark such as `:`. Single words
are no patterns, most stand before anything; neither are words after alone, which follow by chance. Spark scores the graph iteratively: a pattern's confidence is
the share of its instances' scores, smoothed; an instance that is no seed takes the best confidence among its trusted
patterns, those that are confident and have several distinct seeds. Confidences only rise and are rounded, so this comes
to a fixed point, where it stops. Identifier-like strings with a trusted pattern are reported as spans of kind ``id``,
assigned values as ``secret``. All of it is DataFrame expressions.

Positions are recovered without a UDF: what ``split`` leaves between matches and what ``regexp_extract_all`` returns,
laid end to end, give each match's start in code points. Patterns use possessive forms that match the same spans but
neither recurse nor rescan a run, so very long texts take linear time.

Defined results: a null text counts as empty; an empty text has no span; repeated rows have equal spans, one output row
for each input row; an added span never overlaps a seed, nor an id a secret; an empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import bounded, durable

#: Kinds in their listed order, and their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A value assigned to a name that promises a secret, as long as it goes on; 8 letters at least, a digit among them.
SECRET_NAME = r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
SECRET = r"(?<=\b" + SECRET_NAME + r"[\x22']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\x22']?)(?=[A-Za-z_+/=.-]*+[0-9])[A-Za-z0-9_+/-][A-Za-z0-9_+/=.-]{7,}+"
#: Texts without this hold no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Identifier-like: 8 or more ASCII letters, digits, `_`, `=` or `-`, with a digit; the run as a whole, however long.
IDENTIFIER = r"(?<![A-Za-z0-9_=@.-])(?=[A-Za-z_=-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_=-]{7,}+(?<=[A-Za-z0-9])(?!@)"
#: Kinds beyond the fixed ones, in the order they are listed in.
SECRET_KIND, ADDED_KIND = "secret", "id"
#: Letters on either side that context words are taken from; a word that the edge cuts is none.
CONTEXT = 64
#: Letters of a piece that windows are cut from; a window lies within two.
PIECE = 1024
SMOOTHING, CONFIDENT, LEAST_SEEDS = 2.0, 0.5, 3
#: Decimals that confidences are rounded to.
PLACES = 4
#: Matches that are laid end to end at a time.
BLOCK = 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def found(pattern: str, needs: str) -> str:
    """SQL: array of (start, end, value) of the matches of a pattern in column `text`, in code points.

    Matches are laid end to end in blocks of BLOCK, and the blocks behind each other, so that no array grows match by match.
    """
    p, none = quoted(pattern), "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"
    matches = f"zip_with(regexp_extract_all(text, {p}, 0), slice(w, 2, greatest(1, size(w))), (m, after) -> named_struct('m', m, 'size', length(m), 'room', length(m) + length(after)))"
    blocks = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), k -> slice(z, k * {BLOCK} + 1, {BLOCK}))"
    begins = """aggregate(blocks, named_struct('at', bigint(length(w[0])), 'out', cast(array() as array<bigint>)),
        (acc, block) -> named_struct('at', acc.at + aggregate(block, 0L, (sum, x) -> sum + x.room), 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""
    laid = f"""aggregate(block, named_struct('at', begin, 'out', {none}),
        (acc, x) -> named_struct('at', acc.at + x.room, 'out', concat(acc.out, array(named_struct('start', acc.at, 'end', acc.at + x.size, 'value', x.m)))), acc -> acc.out)"""
    return f"""if(text rlike {quoted(needs)},
        transform(array(split(text, {p})), w -> transform(array({matches}), z -> transform(array({blocks}), blocks -> flatten(zip_with(blocks, {begins}, (block, begin) -> {laid})))[0])[0])[0], {none})"""


DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
LUHN = f"""aggregate(
    transform(split(reverse({DIGITS}), ''), (c, i) -> coalesce(try_cast(c as int), 0) * if(i % 2 = 1, 2, 1)),
    0, (sum, d) -> sum + if(d > 9, d - 9, d)) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": r"forall(split(s.value, r'\.'), part -> length(ltrim('0', part)) <= 3 and coalesce(try_cast(ltrim('0', part) as int), 0) <= 255)",
    "card": f"if(length({DIGITS}) between 12 and 19, {LUHN}, false)",
    "phone": f"length({DIGITS}) between 9 and 15",
}


def seeds_sql() -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        kept = f"filter({found(pattern, NEEDS[kind])}, s -> {CHECKS[kind]})"
        parts.append(f"transform({kept}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}', 'value', s.value))")
    return f"array_sort(concat({', '.join(parts)}))"


def outside(spans: str, kind: str, rank: int, taken: str) -> str:
    """SQL: spans under a kind, without those that overlap what is taken."""
    named = f"transform({spans}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}', 'value', s.value))"
    return f"filter({named}, s -> not exists({taken}, t -> t.start < s.end and s.start < t.end))"


BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def context_sql(of: str) -> str:
    """SQL: array of (value, seed, patterns) of the spans of an array; `<` names what stands before, `<>` both sides."""
    folded = lambda part: f"split(trim(translate(lower({part}), '0123456789\t\n\r', '0000000000   ')), ' +')"
    # Windows are cut from pieces of the text, so that a text of many spans isn't walked through for each.
    first, last = f"int(greatest(0, s.start - {CONTEXT}))", "int(s.end)"
    local = lambda at: f"concat(coalesce(get(pieces, {at} div {PIECE}), ''), coalesce(get(pieces, {at} div {PIECE} + 1), ''))"
    before = folded(f"substring({local(first)}, {first} % {PIECE} + 1, int(least({CONTEXT}, s.start)))")
    after = folded(f"substring({local(last)}, {last} % {PIECE} + 1, {CONTEXT})")
    whole = lambda words, cut: f"transform(array({words}), w -> if({cut}, slice(w, 1, size(w) - 1), w))[0]"
    # The words next to the span come first; of a window that the text goes beyond, the last may be a piece.
    near = f"named_struct('b', {whole(f'reverse({before})', f's.start > {CONTEXT}')}, 'a', {whole(after, f'length(text) > s.end + {CONTEXT}')})"
    patterns = """transform(array(w), c -> filter(array(
        if(size(c.b) > 1, concat('< ', c.b[1], ' ', c.b[0]), null),
        if(size(c.b) > 2, concat('< ', c.b[2], ' ', c.b[1], ' ', c.b[0]), null),
        if(coalesce(get(c.b, 0), '') <> '' and coalesce(get(c.a, 0), '') <> '', concat('<> ', get(c.b, 0), ' | ', get(c.a, 0)), null),
        if(get(c.b, 0) rlike '[a-z][^a-z ]*[:=#]$', concat('< ', get(c.b, 0)), null)), p -> p is not null))[0]"""
    each = f"transform({of}, s -> transform(array({near}), w -> named_struct('value', s.value, 'seed', s.rank < {RANKS[ADDED_KIND]}, 'patterns', {patterns}))[0])"
    return f"transform(array(regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0)), pieces -> {each})[0]"


RANKS = {kind: k for k, kind in enumerate([*PATTERNS, SECRET_KIND, ADDED_KIND])}


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, seeds, secrets, others, contexts): spans of the fixed patterns, assigned secrets, identifier-like spans outside both."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("seeds", F.expr(seeds_sql()))
    rows = rows.withColumn("secrets", F.expr(outside(found(SECRET, SECRET_NAME), SECRET_KIND, RANKS[SECRET_KIND], "seeds")))
    rows = rows.withColumn("others", F.expr(outside(found(IDENTIFIER, "[0-9]"), ADDED_KIND, RANKS[ADDED_KIND], "concat(seeds, secrets)")))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "seeds", "secrets", "others", F.expr(context_sql("concat(seeds, secrets, others)")).alias("contexts"))


def graph(spans: DataFrame) -> DataFrame:
    """(value, seed, pattern, n): how often an instance stands in a pattern."""
    each = spans.select(F.explode("contexts").alias("c")).select("c.value", "c.seed", F.explode("c.patterns").alias("pattern"))
    return each.groupBy("value", "seed", "pattern").agg(F.count("*").alias("n"))


def trusted(scores: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns that edges with scores make trusted; the sums are exact."""
    mass = F.sum(F.col("n") * F.col("score").cast(f"decimal(12,{PLACES})")).cast("double")
    patterns = scores.groupBy("pattern").agg(
        F.round(mass / (F.sum("n") + F.lit(SMOOTHING)), PLACES).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds")
    )
    return patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", "confidence")


def confident(edges: DataFrame) -> DataFrame:
    """(value, score) of the instances that are no seeds and stand in a trusted pattern, at the fixed point."""
    first = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scores, mark = edges.withColumn("score", first), None
    while True:
        kept = durable(trusted(scores))
        seen = kept.agg(F.count("*"), F.sum(F.col("confidence").cast(f"decimal(12,{PLACES})"))).first()
        best = edges.where(~F.col("seed")).join(bounded(kept), "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        if mark == tuple(seen):
            return best.select("value", F.col("best").alias("score"))
        mark, best = tuple(seen), durable(best)
        scores = edges.join(bounded(best), "value", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, seeds, added): spans (start, rank, end, kind, value) for each row of docs (doc_id, text)."""
    spans = durable(spans_of(docs).withColumn("id_key", F.xxhash64("doc_id")))
    accepted = durable(confident(durable(graph(spans))))
    places = spans.where(F.size("others") > 0).select("id_key", "text_key", F.explode("others").alias("s")).distinct()
    held = places.join(bounded(accepted), F.col("s.value") == accepted["value"])
    ids = durable(held.groupBy("id_key", "text_key").agg(F.collect_list("s").alias("ids")))  # spans of one text
    added = F.array_sort(F.concat("secrets", F.coalesce("ids", F.array().cast(f"array<{SPAN}>"))))
    return spans.join(bounded(ids), ["id_key", "text_key"], "left").select("doc_id", "seeds", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
