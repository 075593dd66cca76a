import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepool.operators import context, merges, records, retrieval, segments, stats
from tidepool.sources import readers, sinks
from tidepool.streaming import incremental

HITS = "doc_id string, ord int, score double, item_key string, rerank_score double"


def test_filter_before_topk(spark):
    rows = [(f"d{i:05d}", "price", "wanted" if i >= 1200 else "other", ["rare", "cohost"] if i >= 1200 else ["common"], f"{i:05d}", i) for i in range(1210)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, category string, users array<string>, item_key string, doc_index int").withColumn("doc_type", F.lit("scene_summary"))
    top = lambda d: [r.doc_index for r in retrieval.lexical_topk(d, ["price"], 3).collect()]
    assert top(retrieval.payload_filter(docs, categories=["wanted"], participants=["rare", "cohost"])) == [1200, 1201, 1202]
    assert top(retrieval.payload_filter(docs, participants=["rare", "absent"])) == [] and top(docs) == [0, 1, 2]


def test_json_users(spark):
    rows = [('{"users":["a","b"]}', ["a", "b"]), ('{"users":"a"}', ["a"]), ("invalid", None), ("{}", None)]
    got = spark.createDataFrame([(p,) for p, _ in rows], "p string").select(retrieval.json_users(F.col("p")).alias("u")).collect()
    assert [r.u for r in got] == [u for _, u in rows]


def loop_diversify(hits, limit):
    hits, out, seen = sorted(hits, key=lambda h: (-h[4], h[1])), [], Counter()
    for most in (1, 2):
        for h in hits:
            if len(out) < limit and h[3] and h not in out and seen[h[3]] < most:
                out.append(h)
                seen[h[3]] += 1
    return [h[0] for h in out]


def loop_dedupe(hits):
    best, place = {}, {}
    for h in hits:
        if not h[0]:
            continue
        place.setdefault(h[0], h[1])
        if h[0] not in best or h[2] > best[h[0]]:
            best[h[0]] = h[2]
    return sorted((i, place[i], best[i]) for i in best)


def test_diversify_and_dedupe_against_loops(spark):
    rng = random.Random(3)
    for _ in range(4):
        hits = [(f"d{rng.randint(0, 9)}", i, rng.choice([0.1, 0.5, 0.9]), rng.choice(["a", "b", "c", ""]), rng.choice([0.2, 0.4, 0.6])) for i in range(20)]
        frame = spark.createDataFrame(hits, HITS)
        assert sorted((r.doc_id, r.ord, r.score) for r in retrieval.dedupe_hits(frame, ["score"]).collect()) == loop_dedupe(hits)
        unique = [(f"u{i}", *h[1:]) for i, h in enumerate(hits)]
        assert [r.doc_id for r in retrieval.diversify(spark.createDataFrame(unique, HITS), 7).collect()] == loop_diversify(unique, 7)


def test_rerank_prefers_matches(spark):
    rows = [("noise", 0, 0.6, "a", "nothing here"), ("price", 1, 0.6, "b", "聊聊涨价")]
    frame = spark.createDataFrame(rows, "doc_id string, ord int, score double, item_key string, keyword_text string").withColumns(
        {"doc_type": F.lit("scene_summary"), "title": F.lit(""), "item_title": F.lit(None).cast("string"), "timeline_title": F.lit(None).cast("string"), "users": F.array(F.lit("涨价人")), "recall_stage": F.lit("primary")}
    )
    got = retrieval.rerank(frame, ["涨价"]).orderBy(F.desc("rerank_score")).collect()
    assert [r.doc_id for r in got] == ["price", "noise"] and got[1].matched_terms == [] and got[0].matched_terms == ["涨价"]
    assert got[0].rerank_score == pytest.approx(0.6 + 0.12 + 0.02 + 0.05)
    off = retrieval.rerank(frame, ["涨价"], retrieval.Tuning(rerank_enabled=False)).first()
    assert off.rerank_score == off.score and off.why_matched == ["vector_only"]
    assert retrieval.degrade_reason('HTTP 429: {"code":"1113"}') == "embedding_quota_exhausted" and retrieval.degrade_reason("refused") == "semantic_recall_unavailable"
    assert retrieval.Tuning(second_pass_limit=0).second_limit(10) == 60


def test_neighbours_by_time_against_pairs(spark):
    rng = random.Random(5)
    hits = [(f"h{i}", rng.choice("ab"), rng.randint(0, 200_000)) for i in range(20)]
    atoms = [(f"a{i:03d}", rng.choice("ab"), s, s + rng.randint(0, 60_000)) for i, s in enumerate(rng.sample(range(200_000), 80))]
    got = context.neighbours_by_time(spark.createDataFrame(hits, "hit_id string, item_key string, anchor_ms long"), spark.createDataFrame(atoms, "atom_id string, item_key string, start_ms long, end_ms long"))
    want = []
    for h, item, t in hits:
        near = sorted((min(abs(s - t), abs(e - t)), s, a) for a, k, s, e in atoms if k == item and s <= t + 24_000 and e >= t - 24_000 and min(abs(s - t), abs(e - t)) <= 24_000)
        want += [(h, a) for _, _, a in near[:4]]
    assert sorted((r.hit_id, r.atom_id) for r in got.collect()) == sorted(want)


def test_timeline_hints_edges(spark):
    atoms = spark.createDataFrame([("x", "i", 20_000, 30_000)], "atom_id string, item_key string, start_ms long, end_ms long")
    notes = spark.createDataFrame([("n1", "i", 8_000, "a"), ("n2", "i", 7_999, "b"), ("n3", "i", 42_000, ""), ("n4", "i", None, "c"), ("n5", "j", 20_000, "d")], "note_id string, item_key string, anchor_ms long, title string")
    got = context.timeline_hints(atoms, notes).first()
    assert got.note_ids == ["n1", "n3"] and got.note_titles == ["a"]


def loop_atoms(segs):
    anchor = lambda t: "接下来" in t or "感谢收听" in t  # of the phrases, those that the cases hold
    out, now = [], []
    for s in segs:
        if now:
            so_far = now[-1][1] - now[0][0]
            differ = now[-1][3] and s[3] and now[-1][3] != s[3]
            if (s[1] - now[0][0] > 25_000 and so_far >= 12_000) or (anchor(now[-1][2]) and so_far >= 8_000) or (anchor(s[2]) and so_far >= 10_000) or (differ and so_far >= 12_000):
                out, now = [*out, now], []
        now = [*now, s]
        if now[-1][1] - now[0][0] >= 30_000:
            out, now = [*out, now], []
    return out + ([now] if now else [])


def span(g):
    return g[-1][2] - g[0][1]


def loop_merge(groups):
    out = []
    for g in groups:
        if out and span(g) < 45_000 and g[-1][2] - out[-1][0][1] <= 300_000:
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return out


def valid(groups):
    return all(span(g) <= 300_000 for g in groups) and all(span(g) >= 45_000 for g in groups[1:-1])


def loop_scenes(atoms, boundaries=()):
    out, now = [], []
    for a in atoms if boundaries else ():
        now = [*now, a]
        if span(now) > 300_000 and len(now) > 1:
            out, now = [*out, now[:-1]], [a]
        if (a[0] in boundaries and span(now) >= 45_000) or span(now) >= 300_000:
            out, now = [*out, now], []
    out = loop_merge(out + ([now] if now else []))
    if out and valid(out):
        return [[x[0] for x in g] for g in out]
    out, now = [], []
    for a in atoms:
        now = [*now, a]
        if len(now) >= 8 or span(now) >= 180_000:
            out, now = [*out, now], []
    if now:
        out = [*out[:-1], out[-1] + now] if out and len(now) < 4 else [*out, now]
    out = loop_merge(out)
    return [[x[0] for x in g] for g in (out if valid(out) else [list(atoms)])] if atoms else []


def test_folds_against_loops(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(40):
        t, segs = 0, []
        for _ in range(rng.randint(0, 25)):
            n = rng.randint(500, 14_000)
            segs.append((t, t + n, rng.choice(["abc", "接下来说", "x 感谢收听", "d"]), rng.choice([None, "s1", "s2", ""])))
            t += n + rng.randint(0, 2000)
        cases.append(segs)
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s array<{segments.SEGMENT}>")
    got = {r.i: [[tuple(s) for s in a] for a in r.a] for r in frame.select("i", segments.atoms_of(F.col("s")).alias("a")).collect()}
    assert got == {i: loop_atoms(c) for i, c in enumerate(cases)}
    atoms = []
    for c in cases:
        stretch = rng.choice([1, 3, 12])
        atoms.append([(k, s[0] * stretch, s[1] * stretch) for k, s in enumerate(c)])
    cuts = [sorted(rng.sample(range(25), rng.randint(0, 6))) for _ in atoms]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(atoms, cuts))], "i int, a array<struct<idx:int,start_ms:bigint,end_ms:bigint>>, b array<int>")
    got = {r.i: (r.g, r.h) for r in frame.select("i", segments.fallback_scenes(F.col("a")).alias("g"), segments.scenes(F.col("a"), F.col("b")).alias("h")).collect()}
    assert got == {i: (loop_scenes(a), loop_scenes(a, b)) for i, (a, b) in enumerate(zip(atoms, cuts))}


def test_repair_and_chunks(spark):
    noisy = [("oh yeah baby", None), *[("".join(chr(0x4E00 + (i * 25 + k) % 900) for k in range(25)), 0.99) for i in range(60)]]
    frame = spark.createDataFrame([(noisy, "x" * 1500), (noisy[1:], "x"), ([], "")], "segments array<struct<text:string,asr_confidence:double>>, text string")
    got = segments.repaired(frame).collect()
    assert [r.refused for r in got] == [None, "nothing removed", "no segments"] and len(got[0].cleaned) == 60
    word = "struct<segment_index:int,start_ms:bigint,end_ms:bigint,text:string>"
    rows = [("a ", [(0, 5, "a", None)], [(0, 1, 2, "a")], None, "zh", 0), ("", None, None, "m", None, 1000), ("b", [(1, 2, "b", None)], [(0, 1, 2, "b")], "n", "en", 2000)]
    parts = spark.createDataFrame([(rows,)], f"p array<struct<text:string,segments:array<{segments.SEGMENT}>,words:array<{word}>,model_name:string,language:string,offset_ms:bigint>>")
    one = parts.select(segments.shifted(F.col("p")).alias("m")).first().m
    assert (one.text, one.model_name, one.language, one.chunk_count) == ("a\nb", "m", "zh", 3) and [s.start_ms for s in one.segments] == [0, 2001] and [(w.text, w.end_ms) for w in one.words] == [("a", 2), ("b", 2002)]


def test_bridge_skip(spark):
    def payload(source, signature):
        return f'{{"source": "{source}", "bridge_result_signature": "{signature}"}}'

    rows = [("a", "scene_summary", payload("x", "1")), ("a", "episode_card", payload("x", "1")), ("b", "scene_summary", payload("x", "1")), ("c", "scene_summary", payload("y", "1")), ("c", "episode_card", payload("x", "1")), ("d", "scene_summary", payload("x", "0")), ("d", "episode_card", payload("x", "1")), ("e", "scene_summary", "bad"), ("e", "episode_card", payload("x", "1"))]
    results = spark.createDataFrame([(k, "1") for k in "abcdef"], "item_key string, signature string")
    done = lambda **o: sorted(r.item_key for r in merges.bridge_done(spark.createDataFrame(rows, "item_key string, doc_type string, payload_json string"), results, ["x"], **o).collect())
    assert done() == ["a"] and done(full=True) == []


def test_match_summary(spark):
    frame = spark.createDataFrame([("scene_summary", ["a", "b", "c", "d"], "01:00"), ("item_title", ["a"], "01:00"), ("evidence_atom", [], None)], "t string, m array<string>, s string")
    assert [r.x for r in frame.select(retrieval.match_summary(F.col("t"), F.col("m"), F.col("s")).alias("x")).collect()] == ["提到了 a、b、c，命中节目片段摘要，位置约在 01:00", "提到了 a，命中节目标题", "语义命中，匹配到相近描述"]


def test_windows_and_segments(spark):
    got = {n: [tuple(w) for w in spark.range(1).select(segments.windows(F.lit(n)).alias("w")).first().w] for n in (0, 1, 14, 15, 30)}
    assert got == {0: [], 1: [(0, 1)], 14: [(0, 14)], 15: [(0, 14), (11, 15)], 30: [(0, 14), (11, 25), (22, 30)]}
    raw = '[{"start_ms": 5, "end_ms": 3, "text": " a  b "}, {"text": "?!"}, {"start_time": "7", "text": "c", "lang": "zh"}]'
    parsed = spark.createDataFrame([(raw,), ("bad",), (None,)], "s string").select(segments.parse_segments(F.col("s")).alias("p")).collect()
    assert [(s.segment_index, s.start_ms, s.end_ms, s.text, s.language) for s in parsed[0].p] == [(0, 5, 5, "a b", None), (2, 7, 7, "c", "zh")] and parsed[1].p == [] == parsed[2].p


def test_merges(spark):
    old = spark.createDataFrame([("i", 1, "a", "done"), ("i", 2, "b", "error"), ("j", 9, "z", "done")], "item string, job int, title string, state string")
    new = spark.createDataFrame([("i", 2, "B", "pending"), ("i", 3, "C", "pending")], "item string, job int, title string, state string")
    got = merges.merge_keeping(old, new, ["item", "job"], ["state"], scope=["item"]).select("item", "job", "title", "state")
    assert sorted(map(tuple, got.collect())) == [("i", 2, "B", "error"), ("i", 3, "C", "pending"), ("j", 9, "z", "done")]
    again = merges.merge_keeping(got, new, ["item", "job"], ["state"], scope=["item"])
    assert sorted(map(tuple, again.select("item", "job", "title", "state").collect())) == sorted(map(tuple, got.collect()))
    assert sorted(r.job for r in merges.upsert(old, new, ["job"]).collect()) == [1, 2, 3, 9]


def test_reports(spark):
    rows = spark.createDataFrame([(["a ", "b"],), (["b", ""],), (None,)], "m array<string>")
    assert [tuple(r) for r in stats.member_counts(rows, F.col("m")).collect()] == [("b", 2), ("a", 1)] and stats.member_counts(rows, F.col("m"), 1).count() == 1
    empty = spark.createDataFrame([], "status string, transcript_status string")
    assert stats.pipeline_report(empty).first().download_percent == 0


def test_watermarks(spark):
    rows = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-02"), ("c", "2024-01-01"), ("d", None), ("e", "2024-01-03")], "id string, t string")
    assert sorted(r.id for r in incremental.since(rows, "t", "id", "2024-01-02", ["a"]).collect()) == ["b", "d", "e"]
    assert incremental.since(rows, "t", "id", None).count() == 5
    assert tuple(incremental.next_mark(rows.where("t < '2024-01-03'"), "t", "id").first()) == ("2024-01-02", ["a", "b"])
    assert incremental.backoff(2, 3, 5) == 5 and incremental.next_workers(8, 9, 3, 0) == 4 and incremental.next_workers(8, 9, 0, 3) == 9


def test_stream_restart(spark, tmp_path):
    src, seen = f"{tmp_path}/in", []
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    spark.range(5).write.parquet(src)
    incremental.run_available(stream(), lambda df, n: seen.extend(r.id for r in df.collect()), f"{tmp_path}/cp")
    spark.range(5, 7).write.mode("append").parquet(src)
    incremental.run_available(stream(), lambda df, n: seen.extend(r.id for r in df.collect()), f"{tmp_path}/cp")
    assert sorted(seen) == list(range(7))


DOC = """{"data": {"type": "radios", "id": "1", "attributes": {"title": "T", "published-at": "2024", "duration": "12.5", "option-is-official": "true", "content": "{\\"blocks\\":[{\\"text\\":\\" a \\"},{\\"text\\":\\"\\"},{\\"text\\":\\"b\\"}]}", "speech-path": "http://x/s.mp3"},
"relationships": {"category": {"data": {"type": "categories", "id": "7"}}, "user": {"data": [{"type": "users", "id": "5"}, {"type": "users", "id": "6"}]}, "media": {"data": {"type": "medias", "id": "9"}}}},
"included": [{"type": "categories", "id": "7", "attributes": {"name": "cat"}}, {"type": "users", "id": "5", "attributes": {"nickname": "N", "is-official": "true"}},
{"type": "medias", "id": "9", "attributes": {"media-type": "audio", "audio": "http://x/a.mp3", "title": "M"}, "relationships": {"timelines": {"data": [{"type": "timelines", "id": "2"}, {"type": "timelines", "id": "3"}]}}},
{"type": "timelines", "id": "2", "attributes": {"at": "30", "title": "late", "asset": "http://x/i.png"}}, {"type": "timelines", "id": "3", "attributes": {"at": null, "title": "early"}}]}"""


def test_records_and_jobs(spark):
    raw = spark.createDataFrame([(DOC,), ("broken",)], "raw string").select(records.parse_document(F.col("raw")).alias("document"))
    rows = records.normalize_documents(raw)
    r = rows.first()
    assert rows.count() == 1 and (r.item_key, r.title, r.category, r.content_text, r.duration) == ("radios:1", "T", "cat", "a\nb", 12.5)
    assert [u.nickname for u in r.users] == ["N"] and [t.title for t in r.media[0].timelines] == ["early", "late"]
    jobs = {j.job_id: j for j in records.media_jobs(rows).collect()}
    asset, medium = "radios:1:item:1:timeline:2:asset", "radios:1:item:1:media:9"
    assert set(jobs) == {"radios:1:item:1:speech", medium, asset} and jobs[asset].transcript_status == "skipped" and jobs[medium].relpath == "downloads/radios/1/item/1/9.mp3"
    assert jobs[asset].segment_title == "late" and jobs[asset].relpath == "downloads/radios/1/timeline/2/2_asset.png"
    assert "cat" in records.hot_words_of(rows).first().terms


ALBUM = """{"data": {"type": "albums", "id": "5", "attributes": {"title": "A", "duration": "9"}, "relationships": {"published-radios": {"data": [{"type": "radios", "id": "c"}]}, "media": {"data": {"type": "medias", "id": "own"}}}},
"included": [{"type": "radios", "id": "c", "attributes": {"title": "C", "published-at": "2024", "duration": "7"}, "relationships": {"media": {"data": [{"type": "medias", "id": "t"}, {"type": "medias", "id": "v"}, {"type": "medias", "id": "p"}, {"type": "medias", "id": "x"}, {"type": "medias", "id": "o"}]}}},
{"type": "medias", "id": "own", "attributes": {"media-type": "audio", "audio": "a.mp3"}},
{"type": "medias", "id": "t", "attributes": {"media-type": "taptap", "playlist": "/p.m3u8"}}, {"type": "medias", "id": "v", "attributes": {"media-type": "vod"}}, {"type": "medias", "id": "p", "attributes": {"media-type": "hls", "playlist": "//h/q.m3u8"}},
{"type": "medias", "id": "x", "attributes": {"media-type": "protected_audio", "original-src": "y"}, "relationships": {"timelines": {"data": [{"type": "timelines", "id": "z"}]}}}, {"type": "timelines", "id": "z", "attributes": {"asset": "i.png"}}, {"type": "medias", "id": "o", "attributes": {"media-type": "video", "original-src": "/v.mp4"}}]}"""


def test_chapters_and_all_sources(spark):
    site = records.Site("https://s.example", "https://img.example", "https://aud.example")
    answers = {"t": ("taptap", "https://m/x.m3u8", None), "v": ("vod", None, "key")}
    raw = spark.createDataFrame([(ALBUM, answers)], f"raw string, answers map<string,{records.RESOLVED}>").select(records.parse_document(F.col("raw")).alias("document"), "answers")
    rows = records.normalize_documents(raw, site=site, resolved="answers")
    r = rows.first()
    assert r.url == "https://s.example/albums/5" and r.chapters[0].url == "https://s.example/radios/c" and r.media[0].audio_url == "https://aud.example/a.mp3"
    got = {j.media_id: (j.segment_type, j.access_mode, j.media_url, j.play_auth, j.duration, j.chapter_index) for j in records.media_jobs(rows).collect()}
    assert got == {
        "own": ("item", "audio_url", "https://aud.example/a.mp3", None, 9.0, None), "t": ("chapter", "m3u8", "https://m/x.m3u8", None, 7.0, 1), "v": ("chapter", "play_auth", None, "key", 7.0, 1),
        "p": ("chapter", "playlist_url", "https://h/q.m3u8", None, 7.0, 1), "o": ("chapter", "original_src", "https://s.example/v.mp4", None, 7.0, 1), "z_asset": ("timeline", "asset_url", "https://img.example/i.png", None, None, 1),
    }


def test_search_end_to_end(spark, tmp_path):
    from tidepool.functions.embed import HashProvider, hash_embed
    from tidepool.operators.documents import build_documents
    from tidepool.plans.search import RESULT, Memory

    raw = spark.createDataFrame([(DOC,), (DOC.replace('"id": "1", "att', '"id": "2", "att').replace('"title": "T"', '"title": "Other"'),)], "raw string").select(records.parse_document(F.col("raw")).alias("document"))
    rows = records.normalize_documents(raw)
    said = [(k, [(i * 9000, i * 9000 + 8000, f"{word} segment {i}", None) for i in range(12)]) for k, word in (("radios:1", "price"), ("radios:2", "weather"))]
    docs = build_documents(rows, spark.createDataFrame(said, f"item_key string, segments array<{segments.SEGMENT}>")).withColumn("collection_name", F.lit("c"))
    sinks.write_documents(docs, f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert {r.doc_type for r in docs.select("doc_type").distinct().collect()} == {"item_title", "timeline_note", "evidence_atom", "scene_summary", "episode_card"}
    memory = Memory(docs, hash_embed(docs, text="vector_text"), HashProvider())
    found, how = memory.search("price", limit=3)
    best = found.first()
    assert not how["degraded"] and best.item_key == "radios:1" and "price" in best.matched_terms and best.rerank_score > 0
    scene = memory.search("price segment", limit=5, doc_types=["scene_summary"])[0].first()
    assert found.columns == list(RESULT) and scene.neighbor_atoms and scene.display_timestamp == "00:00" and best.match_details[0].kind == "keyword" and best.source_url is None
    shown, _ = Memory(docs, items=rows.withColumn("cover_url", F.lit("c.png"))).search("price", limit=1)
    assert shown.first().cover_url == "c.png" and shown.first().duration == 12.5
    lexical, how = Memory(docs).search("price", limit=3)
    assert how["degraded_reason"] == "semantic_recall_unavailable" and lexical.first().item_key == "radios:1"
    assert memory.participants().first()["name"] == "N" and memory.meta()["items"] == 2 and memory.episode_details("radios:1").count() == 5
    manifest = sinks.export_bundle(docs, hash_embed(docs, text="vector_text"), "c", f"{tmp_path}/bundle")
    assert manifest["documents"] == manifest["vectors"] and sinks.manifest_faults(manifest) == [] and sinks.manifest_faults({})


def test_state_and_ids(spark, tmp_path):
    import uuid

    for payload, at in (({"a": 1}, "1"), ({"a": 2}, "2")):
        sinks.append_state(spark, f"{tmp_path}/s", "k", payload, at)
    assert sinks.read_state(spark, f"{tmp_path}/s").first().payload_json == '{"a": 2}'
    sinks.append_state(spark, f"{tmp_path}/s", "k", None, "3")
    assert sinks.read_state(spark, f"{tmp_path}/s").count() == 0
    assert spark.range(1).select(sinks.point_id(F.lit("x:y")).alias("u")).first().u == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))


def test_readers(spark, tmp_path):
    (tmp_path / "radios").mkdir()
    (tmp_path / "radios" / "1.json").write_text('{"id": "1", "title": "T", "users": [{"id": "5", "nickname": "N", "is_official": true}]}')
    (tmp_path / "radios" / "2.json").write_text("{broken")
    rows = readers.normalized_records(spark, str(tmp_path))
    assert rows.where("id = '1'").first().type == "radios" and readers.count_candidates(spark, str(tmp_path), ["radios"]) == 2
    assert readers.in_scope(rows, official_only=True).count() == 1
    (tmp_path / "words").write_text("abc|3\nabc\n1\n好词\n")
    assert readers.hot_word_list(spark, str(tmp_path / "words")) == ["abc", "好词"] and readers.alias_map('{" a ": "b", "c": "c"}') == {"a": "b"}
    for name, body in (("o", '{"segments": [{"text": " x "}, {"text": "y"}]}'), ("s", '"said"'), ("p", "plain words")):
        (tmp_path / f"t_{name}").write_text(body)
    got = {r.path[-1]: r.text for r in readers.transcript_payloads(spark, f"{tmp_path}/t_*").collect()}
    assert got == {"o": "x\ny", "s": "said", "p": "plain words"}


def test_paged_source(spark):
    spark.dataSource.register(readers.paged_source("pages_of_ints", "id long", lambda offset, n: [(k,) for k in range(offset, offset + n)]))
    assert sorted(r.id for r in spark.read.format("pages_of_ints").option("limit", 4).option("total", 10).load().collect()) == list(range(10))


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(40)]
    points = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    queries = points.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = sorted((r.query_id, r.nth, r.doc_id) for r in retrieval.nearest(points, queries, 3).collect())
    want = []
    for i, q in vectors[::5]:
        best = sorted((-round(sum(a * b for a, b in zip(q, v)), 9), j) for j, v in vectors)[:3]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(best)]
    assert got == sorted(want)


def test_nearest_by_products_of_blocks(spark, monkeypatch, capsys):
    """Copies, ties by rounding, zeros, other lengths, nulls and NaN, over blocks of both sides, as a loop ranks them."""
    rng = random.Random(5)
    vectors = [(i, [rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(3)]) for i in range(60)]
    vectors += [(i, [0.25, 0.5, 1.0]) for i in range(60, 100)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0]), (103, [1.0, 2.0]), (104, [0.25, 0.5, 1.0 + 1e-12])]
    points = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    queries = points.where("doc_id % 7 = 0 OR doc_id >= 99").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "POINT_BLOCK", 16)

    def rank(q, v, j):
        whole = q is not None and v is not None and None not in q and None not in v and len(q) == len(v)
        return (not whole, -round(sum(a * b for a, b in zip(q, v)), 9) if whole else 0, j)

    out = retrieval.nearest(points, queries, 5)
    got = sorted((r.query_id, r.nth, r.doc_id) for r in out.collect())
    asked = [(i, q) for i, q in vectors if i % 7 == 0 or i >= 99]
    assert got == sorted((i, n + 1, key[-1]) for i, q in asked for n, key in enumerate(sorted(rank(q, v, j) for j, v in vectors)[:5]))
    out.explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan  # no pair of a point and a query is a row


def test_nearest_of_nan_comes_first(spark):
    points = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, [float("inf")])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0])], "query_id long, q array<double>")
    assert [r.doc_id for r in retrieval.nearest(points, queries, 2).orderBy("nth").collect()] == [2, 3]


def test_probes_are_measured_against_one_truth(spark, monkeypatch):
    from tidepool.operators import ann

    rng = random.Random(3)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "doc_id long, embedding array<double>")
    queries = points.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    cells, whole, plain = ann.fit(points), [], ann.nearest
    monkeypatch.setattr(ann, "nearest", lambda *a, **more: ("on" in more or whole.append(1)) and None or plain(*a, **more))
    probes, got = ann.probes_for(ann.indexed(points, cells), cells, queries, 5, 0.99)
    assert probes > 2 and got >= 0.99 and len(whole) == 1


def test_index_is_built_and_synced(spark, tmp_path):
    from tidepool.plans.indexing import sync_index

    raw = spark.createDataFrame([(DOC,), (DOC.replace('"id": "1", "att', '"id": "2", "att'),)], "raw string").select(records.parse_document(F.col("raw")).alias("document"))
    rows = records.normalize_documents(raw)
    items = spark.createDataFrame([("radios:1", "2024-01-01T10:00:00+08:00"), ("radios:2", "2024-01-02"), ("radios:3", "2024-01-03")], "item_key string, updated_at string")
    said = [(f"radios:{i}", "2024-01-01T03:00:00Z", [(k * 9000, k * 9000 + 8000, f"segment {k}", None) for k in range(6)] if i < 4 else None) for i in (1, 2, 3)]
    transcripts = spark.createDataFrame(said, f"item_key string, updated_at string, segments array<{segments.SEGMENT}>")
    docs = spark.createDataFrame([], "doc_id string, doc_type string, item_key string, collection_name string")
    jobs = spark.createDataFrame([], "job_key string, item_key string, transcript_id string, job_type string, payload_json string, attempt_count int, status string, last_error string, updated_at string, completed_at string")
    one = sync_index(docs, jobs, items, rows, transcripts, "c", "t1")
    assert one.indexed == 2 and {r.item_key: r.error for r in one.errors.collect()} == {"radios:3": "no normalised record"} and one.mark == "2024-01-01T03:00:00Z"
    assert {(r.item_key, r.status, r.attempt_count) for r in one.jobs.collect()} == {("radios:1", "completed", 1), ("radios:2", "completed", 1), ("radios:3", "error", 1)}
    held = one.documents.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else one.documents
    two = sync_index(held, one.jobs, items, rows, transcripts, "c", "t2", since="2024-01-01T12:30:00+08:00")
    # Later than half past four in the morning, UTC: the second item by its own time, the third by its own as well, or as it has no title.
    assert two.indexed == 1 and {r.item_key: r.attempt_count for r in two.jobs.collect()} == {"radios:1": 1, "radios:2": 2, "radios:3": 2}


def test_overlapping_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, a, a + rng.choice([0, 10, 3000, 200_000, 10**9])) for i, a in enumerate(rng.randint(0, 10**6) for _ in range(120))]
    got = Counter((r.id, r.other) for r in context.overlapping(spark.createDataFrame(rows, "id int, k int, a long, b long"), ["k"], "id", "a", "b").collect())
    want = Counter((x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and x[1] == y[1] and y[2] <= x[3] and y[3] >= x[2])
    assert got == want


def test_web(spark):
    from tidepool.functions import web

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(web.highlight(F.lit("a<b & b"), ["b", "a<b"])) == "<mark>a&lt;<mark>b</mark></mark> &amp; <mark>b</mark>"
    assert one(web.overlap_terms("abcdefg xyz", F.lit("..bcdefg..xy.."))) == ["bcdefg", "xy"] and one(web.overlap_terms("什么", F.lit("什么"))) == []
    assert one(web.version(F.lit("1.x.10"))) == [1, 0, 10] and one(web.media_suffix(F.lit("https://h.x/a/b.MP3?q=1.z"))) == ".MP3" and one(web.media_suffix(F.lit("https://h.x"))) == ""
    assert one(web.media_url_fault(F.lit("https://a.h.x/i"), "h.x")) is None and one(web.json_object(F.lit("[1]"))) is None
    assert one(web.timestamp(F.lit("2024"))) is None and str(one(web.timestamp(F.lit("2024-01-01T08:00:00+0800"))))[:10] == "2024-01-01"


def test_command_line(spark, tmp_path, capsys):
    import json

    from tidepool.__main__ import main

    (tmp_path / "raw.jsonl").write_text(DOC.replace("\n", "") + "\n")
    main(["normalize", f"{tmp_path}/raw.jsonl", f"{tmp_path}/records"])
    rows = spark.read.parquet(f"{tmp_path}/records")
    rows.drop("item_key").withColumn("type", F.lit("radios")).coalesce(1).write.json(f"{tmp_path}/files/radios")
    spark.createDataFrame([("radios:1", [(k * 9000, k * 9000 + 8000, f"price {k}", None) for k in range(6)])], f"item_key string, segments array<{segments.SEGMENT}>").write.parquet(f"{tmp_path}/said")
    main(["build-index", f"{tmp_path}/files", f"{tmp_path}/said", f"{tmp_path}/index", "--collection", "c"])
    main(["search", f"{tmp_path}/index", "price", "--limit", "2"])
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["results"][0]["item_key"] == "radios:1" and len(found["results"][0]) == 34
    main(["participants", f"{tmp_path}/index"])
    assert json.loads(capsys.readouterr().out)["name"] == "N"
    main(["set-state", f"{tmp_path}/log", "k", "1", "--payload", '{"a": 1}'])
    main(["state", f"{tmp_path}/log", "k"])
    assert '{\\"a\\": 1}' in capsys.readouterr().out
    main(["media-jobs", f"{tmp_path}/files", f"{tmp_path}/jobs"])
    main(["queue", f"{tmp_path}/jobs", "download", "--limit", "1"])
    assert json.loads(capsys.readouterr().out)["transcript_status"] == "pending"
    main(["export-bundle", f"{tmp_path}/index", f"{tmp_path}/bundle", "--collection", "c"])
    assert json.loads(capsys.readouterr().out)["documents"] > 3
    main(["copy-vectors", f"{tmp_path}/index/vectors", f"{tmp_path}/copied", "c", "d"])
    main(["count-vectors", f"{tmp_path}/copied", "--collection", "d"])
    assert int(capsys.readouterr().out) == spark.read.parquet(f"{tmp_path}/index/vectors").count()


def test_gram_index_finds_what_a_scan_finds(spark, tmp_path):
    from tidepool.operators import gram_index

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abAB cé漢") for _ in range(rng.randint(0, 30))), "t", str(i % 3), i) for i in range(300)] + [(900, None, "t", "0", 1), (901, "x" * 50_000 + "Needle", "t", "0", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, doc_type string, item_key string, doc_index int")
    gram_index.write_index(docs, f"{tmp_path}/grams")
    index = gram_index.read_index(spark, f"{tmp_path}/grams")
    for terms in (["abc", "BAB"], ["needle"], ["é漢a", "zzz"], ["ab", "abc"], []):
        want = [r.doc_id for r in retrieval.lexical_topk(docs, terms, 40).collect()]
        assert [r.doc_id for r in gram_index.indexed_topk(docs, index, terms, 40).collect()] == want
