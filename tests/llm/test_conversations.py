"""Repair of conversations, their prefix trie and the URL filter, against brute force and on awkward frames."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing
from tidepool.llm import prefix_trie, repair, streams, url_filter
from tidepool.llm.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def conversations(spark, rows):
    return spark.createDataFrame(rows, CONVERSATIONS)


def awkward(spark):
    rows = [(c, t, role, f"turn {t} of {c}" + end) for c in range(20) for t, role, end in ((0, "system", "."), (1, "user", "?"), (2, "assistant", ""), (2, "user", "!"), (4, "assistant", "."))]
    rows += [(None, 1, "user", "no id."), (None, None, None, None), (21, None, None, "x."), (21, None, "", ""), (22, 1, "user", None), (-3, 0, "user", "long " * 20000 + "."), (-3, 1, "assistant", "a.")]
    rows += [(23, 5, "user", "same.")] * 4 + [(24, t, "user", "tie.") for t in (1, 1, 1, 2)] + [(30, t, "user", f"{t}.") for t in range(40)]
    return conversations(spark, rows)


# 11. Repair.


def of_signs(signs, depth):
    """Cheapest (cost, audit) by trying all edits, with at most ``depth`` insertions before each turn and at the end."""
    best = None
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    choices = ["D" if s == "d" else "KRD" for s in signs]
    for letters in product(*choices):
        for n in product(range(depth + 1), repeat=len(signs) + 1):
            audit = "".join("I" * k + x for k, x in zip(n, [*letters, ""]))
            for first in ("", "s") if letters and "K" in letters else ("",):
                roles = [i if x == "K" else "?" for x, i in zip(letters, (s.lower() for s in signs)) if x != "D"]
                line, at = "", 0
                for x in audit:
                    if x == "D":
                        continue
                    body = line[1:] if first else line
                    want = "ua"[len(body) % 2] if line or not first else "s"
                    if x == "K":
                        line += roles[at]
                        at += 1
                    elif want == "s":
                        line = "!"
                    else:
                        line += want
                        at += x == "R"
                if re.fullmatch(r"(s?(ua)+)?", line) and line.startswith("s") == bool(first):
                    cost = sum(price[x] for x in audit) + 3 * sum(s.isupper() and x != "D" for s, x in zip(signs, letters))
                    best = min(best or (cost, audit), (cost, audit))
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="dsuaxSUAX", max_size=4))
def test_cheapest_edits(signs):
    assert repair.cheapest(signs) == of_signs(signs, 2)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="dsuaxSUAX", max_size=24), st.integers(1, 9))
def test_pieces_make_the_whole_path(signs, size):
    now = {0: (0, "")}
    for at in range(0, len(signs), size):
        part = signs[at : at + size]
        now = repair.joined(now, [(e, x, *path) for e in range(4) for x, path in repair.search(part, e, (0, 1, 2, 3), True).items()])
    if len(signs) == 0:
        now = {0: (0, "")}
    assert min(now[s] for s in repair.ACCEPTING if s in now) == repair.cheapest(signs)


def brute_repair(rows):
    """From rows after damage (conv_id, turn, role, text), by definition."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if role is None else role, " " if text is None else text) for k, t, role, text in rows if k == c))
        seen, signs = set(), ""
        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for _, _, role, text in mine:
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "" if BLANK.findall(text)[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            sign = role[:1] if role[:1] and role[:1] in "sua" else "x"
            signs += "d" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        count["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [t for given, t, _, _ in mine if given]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = repair.cheapest(signs)
        said = "\n".join(repair.lines(audit, [(r, t) for _, _, r, t in mine]))
        out[c] = (gaps, *count.values(), cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text or "") if fate == 2 else text
        out += [] if fate == 0 else [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


@pytest.mark.parametrize("piece_rows", [512, 3])
def test_repair(spark, piece_rows):
    frame = awkward(spark)
    rows = brute_damage([tuple(r) for r in frame.collect()])
    want = brute_repair(rows)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want |= {r["conv_id"]: none for r in frame.select("conv_id").distinct().collect() if r["conv_id"] not in want}
    for damaged in (frame, clashing(frame.repartition(7))):
        got = repair.repair(repair.damaged(damaged), piece_rows).collect()
        assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_one_long_conversation_among_many_tasks(spark):
    draw = random.Random(5)
    rows = [(7, t, draw.choice(("user", "assistant", "system")), draw.choice(("yes.", f"turn {t}.", f"cut {t}", ""))) for t in range(600)]
    rows += [(c, 0, "user", "hi.") for c in range(20, 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair(conversations(spark, rows).selectExpr("*", "1L as copies"), 50).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(conversations(spark, []))).count() == 0


# 12. Prefix trie.


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
    members = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in inside if len(whole[c]) == len(node))
        out.append(
            (
                min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(n) == len(node) + 1 for n in below),
                sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("first, most", [(1, 1), (2, 4), (16, 4096)])
def test_trie(spark, first, most):
    draw = random.Random(3)
    longest = 4 if most == 1 else 12  # a round for each turn
    rows = [(c, t, draw.choice(("user", "assistant")), draw.choice(("yes", "nö", ""))) for c in range(40) for t in range(draw.randrange(1, longest))]
    rows += [(100 + c, t, "user", f"copy {t}") for c in range(30) for t in range(longest - 2)]
    rows += [(c, t, None, None) for c in (-7, -3, 0, 61) for t in (None, 2, 2)] + [(None, 1, "user", "x")]
    frame = conversations(spark, rows)
    want = brute_trie(rows)
    assert trie_rows(prefix_trie.prefix_trie(frame, first, most)) == want
    if first == 2:
        assert trie_rows(prefix_trie.prefix_trie(clashing(frame.repartition(5)), first, most)) == want


def test_trie_of_awkward_rows(spark):
    frame = awkward(spark)
    assert trie_rows(prefix_trie.prefix_trie(frame)) == brute_trie([tuple(r) for r in frame.collect()])


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # takes its beginning from a conversation that isn't there
    got = prefix_trie.prefix_trie(conversations(spark, [(alone, 0, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_digests_of_runs_over_many_tasks(spark):
    rows = [(a, b, i) for a in range(3) for b in range(4) for i in range(-5, 300 if (a, b) == (1, 2) else b)]
    got = streams.digests(spark.createDataFrame(rows, "a long, b long, i long").repartition(9), "a", "b", "i", limit=64).collect()
    want = {(a, b): hashlib.sha256(",".join(str(i) for x, y, i in rows if (x, y) == (a, b)).encode()).hexdigest() for a, b, _ in rows}
    assert len(got) == len(want) and {(r["a"], r["b"]): r["digest"] for r in got} == want


# 13. URL filter.


def as_regex(glob):
    return re.compile(b".*".join(b"[^/]*".join(re.escape(x) for x in part.encode().split(b"*")) for part in glob.split("**")), re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab/*.é", max_size=9), min_size=1, max_size=30), st.lists(st.text(alphabet="ab/.é", max_size=14), max_size=6))
def test_globs_are_regular_expressions(globs, texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    got = url_filter.Automaton.of(globs).matched(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [[as_regex(g).fullmatch(t) is not None for g in globs] for t in data]


def brute_verdict(url, rules=url_filter.RULES, globs=url_filter.GLOBS):
    host = path = query = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0]
        rest, mark, query = rest.partition("?")
        host, slash, path = rest.partition("/")
        host, path, query = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path, mark + query
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hit = [(len(g), v, g) for v, g in globs if as_regex(g).fullmatch((host + path + query).encode())]
    glob = max(hit)[2] if hit else None
    return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else max(hit)[1] if hit else "allow" if host + path else "block", glob


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://a.Org/x", "https://org", "http://notexample.org/es/", "http://example.org/es/1", "http://example.org/en/12?x#y", "x://www.example.org/en/1",
    "http://www.example.com/fr/?page=2", "http://de.com/de/", "http://com/de", "http://a.net/login", "http://a.net/b/login.php", "http://ads.net/fr/", "http://a.net/pic.PNG", "http://a.net/pic.png?x", "http://a.net/pic.png",
    "http://a.net/list?page=3", "http://docs.a.net/list?page=3", "http://a.net/q?a=1&sessionid=9#f", "http://b\nnet/x\ny", "http://é.net/é?é", "http://a.net?x/y", "http://a.net#x/y", "mailto:a://b://c/d", "http://a.net/" + "long/" * 3000 + "x.js", "http://.org/",
]


def test_verdicts(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(URLS)] + [(None, "http://org/", None), (5, URLS[5], "<html>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(((i, *brute_verdict(u)) for i, u, _ in rows), key=repr)
    for pages in (frame, frame.repartition(3).selectExpr("*", "'x' as host", "'x' as rule", "'x' as query", "'x' as hosted")):
        assert sorted((tuple(r) for r in url_filter.judge_urls(pages).collect()), key=repr) == want
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


def test_many_rules_fill_many_words(spark):
    rules = [("block" if k % 2 else "allow", f"h{k % 7}.net", f"/p{k}/") for k in range(200)] + [("block", "h1.net", "/p1/"), ("allow", "h1.net", "/p1/")]
    rows = [(k, f"http://{'x.' * (k % 3)}h{k % 7}.net/p{k}/rest") for k in range(220)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, ()).collect()}
    assert got == {i: brute_verdict(u, rules, ())[2:4] for i, u in rows}


def test_no_shuffle_of_pages(spark, sf_dir, capsys):
    QUERIES["op13_url_filter"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "html" not in plan


