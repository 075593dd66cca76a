"""The queries opN_<name>, each applying one operator of this subpackage to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.decontamination import decontaminate
from tidepool.llm.language import identify_languages
from tidepool.llm.language_model import score_texts
from tidepool.llm.licenses import scan_licenses
from tidepool.llm.mixing import copies, mix
from tidepool.llm.personal_data import PATTERNS, find_personal_data, listed
from tidepool.llm.prefix_trie import prefix_trie
from tidepool.llm.quality import score_quality
from tidepool.llm.repair import damaged, repair
from tidepool.llm.sampling import in_fold
from tidepool.llm.sharding import shard
from tidepool.llm.simhash import near_duplicates
from tidepool.llm.tables import table
from tidepool.llm.toxicity import score_toxicity
from tidepool.llm.url_filter import GLOBS, RULES, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    span = lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["errors"].cast("string"))
    return out.withColumn("spans", F.array_join(F.transform("spans", span), ","))


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


_WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op4_decontamination"] = rf"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS p
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT DISTINCT doc_id, k, w, len(w) AS total FROM d),
placed AS (SELECT doc_id, k, total, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
       FROM (SELECT doc_id, k, w, total, n, unnest(generate_series(1, total - n + 1)) AS i FROM dw, sizes WHERE total >= n)),
hit AS (SELECT x.doc_id, x.k, x.i, x.n, bw.item_id FROM placed x JOIN bw ON x.p = bw.p AND x.n = bw.n),
pos AS (SELECT doc_id, k, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, k, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY ALL),
ids AS (SELECT doc_id, k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, k, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY ALL),
phrases AS (SELECT DISTINCT p FROM bw),
terms AS (SELECT p, unnest(string_split(p, ' ')) AS term, generate_subscripts(string_split(p, ' '), 1) - 1 AS o FROM phrases),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
ranked AS (SELECT p, terms.term, o, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY p ORDER BY coalesce(n, 0), o) AS r FROM terms LEFT JOIN counts ON terms.term = counts.term),
anchor AS (SELECT * FROM ranked WHERE r = 1 AND n > 0),
rest AS (SELECT x.p, x.r, x.term FROM ranked x JOIN anchor a ON x.p = a.p WHERE x.r IN (2, 3) AND x.n <= 16 * a.n),
lists AS (SELECT p, count(*) AS n FROM rest GROUP BY p),
seek AS (SELECT term FROM anchor UNION SELECT term FROM rest),
post AS (SELECT * FROM (SELECT doc_id, k, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS j FROM dw) WHERE term IN (SELECT term FROM seek)),
found AS (SELECT DISTINCT post.doc_id, post.k, a.p, post.j FROM anchor a JOIN post ON a.term = post.term WHERE post.j >= a.o),
close AS (SELECT f.doc_id, f.k, f.p, f.j FROM found f JOIN rest ON f.p = rest.p JOIN post ON post.doc_id IS NOT DISTINCT FROM f.doc_id AND post.k = f.k AND post.term = rest.term AND abs(post.j - f.j) < 13
       JOIN lists ON f.p = lists.p GROUP BY f.doc_id, f.k, f.p, f.j, lists.n HAVING count(DISTINCT rest.r) = lists.n),
near AS (SELECT close.doc_id, close.k, count(DISTINCT bw.item_id) AS n_near FROM close JOIN bw ON close.p = bw.p GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos ON d.doc_id IS NOT DISTINCT FROM pos.doc_id AND d.k = pos.k LEFT JOIN ids ON d.doc_id IS NOT DISTINCT FROM ids.doc_id AND d.k = ids.k
LEFT JOIN near ON d.doc_id IS NOT DISTINCT FROM near.doc_id AND d.k = near.k
"""


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    number = {f"n_{kind}": F.expr(f"bigint(size(filter(seeds, s -> s.kind = '{kind}')))") for kind in PATTERNS}
    return out.withColumns(number).select(
        "doc_id", *number, F.sha2(listed(F.col("seeds")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("seeds", "added"))).alias("spans")
    )


# Columns of the operators' results that SQL can express, each from its operator, beside the queries above.

_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = _WORDS.format("text")


@query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of op3's sources."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.groupBy("source", "source_size").agg(F.round(F.max("target"), 6).alias("target"), F.sum("rows").alias("documents"))


ORACLES["mix_targets"] = rf"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), {_SPACED})))::BIGINT AS size, count(*) AS documents FROM documents GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * size / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * size / weight, source) AS k FROM w),
cuts AS (SELECT k, ratio, (1.5 * (SELECT sum(size) FROM w) - coalesce(2.0 * sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, coalesce(lag(ratio) OVER (ORDER BY k), 0) AS below FROM o),
level AS (SELECT max(level) AS level FROM cuts WHERE below <= level AND level <= ratio)
SELECT source, size AS source_size, round(least(2.0::DOUBLE * size, weight * level.level), 6) AS target, documents FROM w, level
"""


@query
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of op6's records, and how near to equal its shards are."""
    out = shard(table(spark, sf_dir, "documents"))
    each = out.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.max("size").alias("largest"))
    near = F.max("size") - F.min("size") <= 2 * F.max("largest")
    return each.agg(F.sum("size").alias("bytes"), F.count("*").alias("shards"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("gapless"), near.alias("near"))


ORACLES["shard_sizes"] = "SELECT sum(coalesce(strlen(text), 0) + 16)::BIGINT AS bytes, least(40, count(*)) AS shards, true AS gapless, true AS near FROM documents"


@query
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of op1."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").limit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLES["quality_counts"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS p FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, p) AS n FROM win) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS j FROM twice) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(hit.n, 0) AS n_repeat_words FROM d LEFT JOIN hit USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


@query
def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base phrases of op5."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLES["license_base"] = rf"""
WITH p AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat(
    list_transform(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license'), lambda i: {{'at': i - 1, 'label': 'mit'}}),
    list_transform(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license'), lambda i: {{'at': i - 1, 'label': 'apache'}}),
    list_transform(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'), lambda i: {{'at': i - 1, 'label': 'gpl'}})) AS x
FROM (SELECT doc_id, {_PLAIN} AS w FROM documents))
SELECT doc_id, n_words, len(x)::BIGINT AS n_base, list_min(list_transform(x, lambda e: e.at)) AS first_word, list_max(list_transform(x, lambda e: e.at)) AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(x, lambda e: e.label))), ',') AS base_labels FROM p
"""


@query
def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op9."""
    return op9_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


ORACLES["personal_data_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+){3}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: try_cast(y AS HUGEINT))) <= 255))::BIGINT AS n_ip,
    list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 12 AND 19) AS cards,
    len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM d)
SELECT doc_id, n_email, n_ip, n_phone, len(list_filter(cards, lambda x: list_sum(list_transform(string_split(reverse(x), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0))::BIGINT AS n_card FROM m
"""


# Conversations and pages. CRC-32 in SQL: a step of eight shifts for each byte; keys have digits, signs, : and spaces alone.

_CRC = """xor(list_reduce(list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
    lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(acc, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, regexp_replace(text, '[ 	-
]+$', '') AS body FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM n),
m AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM f),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
ins(a, b, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
op(initial, a, b, cost, audit) AS (VALUES ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('a', 2, 3, 0, 'K'), ('u', 3, 2, 0, 'K'),
      ('*', 0, 2, 3, 'R'), ('*', 1, 2, 3, 'R'), ('*', 2, 3, 3, 'R'), ('*', 3, 2, 3, 'R'), ('-', 0, 0, 4, 'D'), ('-', 1, 1, 4, 'D'), ('-', 2, 2, 4, 'D'), ('-', 3, 3, 4, 'D')),
step AS (SELECT m.conv_id, m.k, ins.a, op.b, min({{'cost': ins.cost + op.cost + CASE WHEN fault = 'truncated' AND op.audit <> 'D' THEN 3 ELSE 0 END, 'audit': ins.audit || op.audit}}) AS best
      FROM m JOIN op ON op.initial = '-' OR (fault IN ('', 'truncated') AND (op.initial = '*' OR op.initial = m.initial)) JOIN ins ON ins.b = op.a GROUP BY ALL),
path AS (SELECT conv_id, 0::BIGINT AS k, 0 AS state, 0 AS cost, '' AS audit FROM facts
  UNION ALL SELECT conv_id, k, state, best.cost, best.audit FROM (SELECT p.conv_id, s.k, s.b AS state, min({{'cost': p.cost + s.best.cost, 'audit': p.audit || s.best.audit}}) AS best
      FROM path p JOIN step s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = p.k + 1 AND s.a = p.state GROUP BY p.conv_id, s.k, s.b)),
ended AS (SELECT p.conv_id, min({{'cost': p.cost + ins.cost, 'audit': p.audit || ins.audit}}) AS best FROM path p JOIN facts ON p.conv_id IS NOT DISTINCT FROM facts.conv_id AND p.k = facts.n
      JOIN ins ON ins.a = p.state AND ins.b IN (0, 3) GROUP BY p.conv_id),
letters AS (SELECT conv_id, i, best.audit[i] AS letter, length(replace(best.audit[1:i], 'I', '')) AS k FROM (SELECT *, unnest(generate_series(1, length(best.audit))) AS i FROM ended)),
kept AS (SELECT l.conv_id, i, letter, CASE WHEN letter = 'K' THEN m.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text,
      count(*) FILTER (NOT (letter = 'K' AND m.role LIKE 's%')) OVER (PARTITION BY l.conv_id ORDER BY i) AS nth FROM letters l LEFT JOIN m ON l.conv_id IS NOT DISTINCT FROM m.conv_id AND l.k = m.k WHERE letter <> 'D'),
said AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i) AS whole FROM kept GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN facts ON d.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN ended ON d.conv_id IS NOT DISTINCT FROM ended.conv_id LEFT JOIN said ON d.conv_id IS NOT DISTINCT FROM said.conv_id
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(said ORDER BY k) AS said FROM t GROUP BY conv_id),
r AS (SELECT l.conv_id, list_concat(coalesce(b.said, [])[1:h], l.said[h + 1:]) AS said FROM (SELECT *, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM l) l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 5),
p AS (SELECT conv_id, len(said) AS length, d AS depth, said[1:d] AS prefix FROM (SELECT *, unnest(generate_series(0, len(said))) AS d FROM r)),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n, coalesce(strlen(prefix[depth]['text']), 0) AS bytes, max(length) AS deepest,
      sha256(coalesce(string_agg(CASE WHEN length = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM p GROUP BY depth, prefix),
up AS (SELECT x.conv_id, x.depth, a.depth AS above, a.conv_id AS ancestor, (x.n - 1) * x.bytes AS saved, (x.deepest = x.depth)::BIGINT AS leaf FROM node x JOIN node a ON a.depth <= x.depth AND a.prefix = x.prefix[1:a.depth]),
below AS (SELECT above AS depth, ancestor AS conv_id, count(*) FILTER (depth = above + 1) AS children, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM up GROUP BY above, ancestor)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below ON node.depth = below.depth AND node.conv_id = below.conv_id LEFT JOIN node parent ON parent.depth = node.depth - 1 AND parent.prefix = node.prefix[1:node.depth - 1]
"""


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "method_glob")


def _pattern(glob: str) -> str:
    """A glob as a regular expression."""
    return "(?s)^" + ".*".join("[^/]*".join(re.escape(piece) for piece in part.split("*")) for part in glob.split("**")) + "$"


_RULE_ROWS = ", ".join(f"('{v}', '{name}', '{start}')" for v, name, start in RULES)
_GLOB_ROWS = ", ".join(f"('{v}', '{g}', '{_pattern(g)}')" for v, g in GLOBS)
ORACLES["op13_url_filter"] = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, strpos(coalesce(url, ''), '://') AS place, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
h AS (SELECT r, page_id, CASE WHEN place > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
      CASE WHEN place > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path, CASE WHEN place > 0 THEN regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) ELSE '' END AS query FROM u),
rules(verdict, name, start) AS (VALUES {_RULE_ROWS}),
globs(verdict, shape, pattern) AS (VALUES {_GLOB_ROWS}),
fit AS (SELECT r, verdict, name || start AS rule, row_number() OVER (PARTITION BY r ORDER BY length(name || start) DESC, length(name) DESC, verdict DESC) AS nth
      FROM h JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)),
hit AS (SELECT r, verdict, shape, row_number() OVER (PARTITION BY r ORDER BY length(shape) DESC, verdict DESC) AS nth FROM h JOIN globs ON regexp_matches(host || path || query, pattern))
SELECT h.page_id, host, path, fit.rule, coalesce(fit.verdict, hit.verdict, CASE WHEN host || path <> '' THEN 'allow' ELSE 'block' END) AS verdict, hit.shape AS method_glob
FROM h LEFT JOIN fit ON h.r = fit.r AND fit.nth = 1 LEFT JOIN hit ON h.r = hit.r AND hit.nth = 1
"""
