"""Point tables, postings, collections and catalogues that change in place; writers, streams and logs."""

import glob
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidepool.functions.embed import HashProvider, hash_embed
from tidepool.operators import ann, gram_index, records, retrieval, stats
from tidepool.plans import writing
from tidepool.plans.collection import Collection
from tidepool.plans.search import Memory, searched
from tidepool.sources import library, paged_stream, parts, readers
from tidepool.sources.points import PointTable, reached
from tidepool.streaming import audit, bridge, crawl

WORDS = "price weather music game story night river stone light paper".split()


def documents(spark, n=240, items=30):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(12))
        kind = ("scene_summary", "episode_card", "evidence_atom", "timeline_note")[i % 4]
        rows.append(("c" if i % 5 else "d", f"{i % items}:{i}", str(i % items), kind, "ab"[i % 2], ["N", f"u{i % 3}"], text, text))
    return spark.createDataFrame(rows, "collection_name string, doc_id string, item_key string, doc_type string, category string, users array<string>, keyword_text string, vector_text string")


def points(spark, n=600, dim=16):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [("ab"[i % 2], i, str(i % 20), str(i % 4), str(i % 3), ["all", f"u{i % 9}"], [c + rng.gauss(0, 0.4) for c in centres[rng.randrange(12)]]) for i in range(n)]
    return spark.createDataFrame(rows, "collection_name string, doc_id long, item_key string, doc_type string, category string, users array<string>, embedding array<float>")


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_filters_reach_the_files_and_no_vector_is_shuffled(spark, tmp_path, capsys):
    rows = points(spark)
    table = PointTable.create(rows, f"{tmp_path}/p")
    asked = rows.where("doc_id = 5").first()["embedding"]
    scope = {"collection": "a", "doc_types": ["0", "2"], "categories": ["1"], "participants": ["all"]}
    found = table.search(asked, 7, **scope)
    plan = plan_of(found, capsys)
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Join" not in plan
    assert "collection_name" in plan.split("PartitionFilters")[1].split("\n")[0] and "In(doc_type" in plan.split("PushedFilters")[1].split("\n")[0]
    want = retrieval.vector_topk(retrieval.payload_filter(rows.where("collection_name = 'a'"), ["0", "2"], ["1"], ["all"]), asked, 7)
    assert ids(found) == ids(want) and len(ids(want)) == 7
    near = plan_of(table.search(asked, 7, probes=2, **scope), capsys)
    assert "cell" in near.split("PartitionFilters")[1].split("\n")[0] and "Exchange" not in near


def test_recall_holds_under_filters(spark, tmp_path):
    rows = points(spark)
    queries = rows.where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    table = PointTable.create(rows, f"{tmp_path}/p").tuned(queries, 5)
    assert table.probes < len(table.cells.centroids)
    for scope in ({"collection": "a"}, {"collection": "b", "doc_types": ["1"], "participants": ["u1"]}, {"collection": "a", "categories": ["nothing"]}):
        assert table.recall(queries, 5, table.probes, **scope) >= 0.9
    # The search for one vector and for many read the same cells.
    one = queries.orderBy("query_id").first()
    single = table.search(one["q"], 5, table.probes, collection="b", doc_types=["1"], participants=["u1"])
    many = table.search_many(queries, 5, table.probes, collection="b", doc_types=["1"], participants=["u1"]).where(F.col("query_id") == one["query_id"])
    assert set(ids(single)) == set(ids(many))
    assert reached([3, 1, 2], {1: 1, 2: 500}, 1, 5) == [1, 2] and reached([3, 1], {}, 2, 5) == [] and reached([1, 2], {1: 900, 2: 9}, 1, 5) == [1]


def test_many_searches_meet_by_cell_without_a_row_for_each_pair(spark, tmp_path, capsys):
    table = PointTable.create(points(spark), f"{tmp_path}/p")
    queries = table.rows().where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    table.search_many(queries, 5, 3, collection="a").explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    every = len(table.cells.centroids)
    exact = sorted(ids(table.nearest(queries, 5, collection="a")))
    assert sorted(ids(table.search_many(queries, 5, every, collection="a"))) == exact


def test_upserts_rewrite_touched_cells_only(spark, tmp_path):
    rows = points(spark)
    table = PointTable.create(rows, f"{tmp_path}/p")
    state = lambda: {r["doc_id"]: (r["collection_name"], tuple(r["embedding"])) for r in table.rows().collect()}
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/p/points") for f in fs if f.endswith(".parquet")}
    before, held = state(), files()
    new = rows.where("collection_name = 'a' AND item_key = '4'").withColumn("embedding", F.transform("embedding", lambda x: -x))
    touched = table.upsert(new)
    want = before | {r["doc_id"]: ("a", tuple(r["embedding"])) for r in new.collect()}
    assert state() == want and 0 < touched and len(held & files()) > 0
    # A cell that loses all rows is empty, and stays so.
    one = table.rows().where("collection_name = 'a'").first()["cell"]
    gone = table.rows().where(f"collection_name = 'a' AND cell = {one}").select("collection_name", "item_key").distinct()
    keys = {(r[0], r[1]) for r in gone.collect()}
    table.replace(rows.limit(0), gone)
    left = {r["doc_id"]: v for r, v in ((r, want[r["doc_id"]]) for r in rows.collect()) if (r["collection_name"], r["item_key"]) not in keys}
    assert state() == left and table.rows().where(f"collection_name = 'a' AND cell = {one}").count() == 0
    table.replace(rows.limit(0), rows.where("doc_id < 0"))
    assert state() == left


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    rows = points(spark, 60)
    table = PointTable.create(rows, f"{tmp_path}/p")
    held = sorted(ids(table.rows()))
    with pytest.raises(Exception, match="no vector for"):
        table.upsert(rows.where("item_key = '4'").withColumn("embedding", F.lit(None).cast("array<float>")))
    assert sorted(ids(table.rows())) == held
    bad = spark.range(4).select(F.lit("4").alias("item_key"), F.lit(0).alias("part"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("v"))
    parts.write(spark.createDataFrame([("4", 0, "a")], "item_key string, part int, v string"), f"{tmp_path}/t", ["part"])
    with pytest.raises(Exception, match="lost"):
        parts.replace(f"{tmp_path}/t", bad, bad.select("item_key"), ["part"], ["item_key"])
    assert [r["v"] for r in parts.live(spark, f"{tmp_path}/t").collect()] == ["a"]


class Counting(HashProvider):
    """Counts the texts that it embeds, in files, as tasks may run anywhere."""

    def __init__(self, place):
        super().__init__(32)
        self.place = place

    def embed_documents(self, texts):
        for t in texts:
            with open(os.path.join(self.place, str(random.random())), "w") as f:
                f.write(t)
        return super().embed_documents(texts)


def test_synced_index_equals_a_rebuild(spark, tmp_path):
    place = tmp_path / "texts"
    place.mkdir()
    make = lambda: Counting(str(place))
    docs = documents(spark)
    index = Collection.create(docs, f"{tmp_path}/i", make, part_docs=60)
    assert len(list(place.iterdir())) == 240
    changed = docs.where("item_key IN ('3', '7')").withColumn("vector_text", F.when(F.col("item_key") == "3", F.concat(F.lit("needle "), "vector_text")).otherwise(F.col("vector_text"))).withColumn("keyword_text", F.col("vector_text"))
    one = index.sync(changed, changed.select("collection_name", "item_key"))
    assert one.embedded == 8 and len(list(place.iterdir())) == 248 and one.postings < 5
    gone = docs.where("item_key = '5'")
    fresh = gone.limit(1).withColumn("item_key", F.lit("x")).withColumn("doc_id", F.lit("x:1")).withColumn("keyword_text", F.lit("needle")).withColumn("vector_text", F.lit("needle"))
    two = index.sync(fresh, gone.unionByName(fresh).select("collection_name", "item_key"))
    assert two.embedded == 1 and index.sync(fresh, fresh.select("collection_name", "item_key")).embedded == 0
    now = docs.where("item_key NOT IN ('3', '5', '7')").unionByName(changed).unionByName(fresh)
    again = Collection.create(now, f"{tmp_path}/j", lambda: HashProvider(32), part_docs=60)
    for name in ("documents", "postings"):
        kept = [c for c in getattr(index, name)().columns if c != "part"]
        rows = lambda x, name=name, kept=kept: sorted(map(str, getattr(x, name)().select(*kept).collect()))
        assert rows(index) == rows(again)
    vectors = lambda x: sorted((r["collection_name"], r["doc_id"], r["text_key"], tuple(r["embedding"])) for r in x.points().rows().collect())
    assert vectors(index) == vectors(again)
    asked = HashProvider(32).one("needle river")
    for probes in (None, 99):
        got = [index.points().search(asked, 9, probes=probes, collection="c").select("doc_id").collect(), again.points().search(asked, 9, probes=probes, collection="c").select("doc_id").collect()]
        assert got[0] == got[1]


def test_memory_searches_through_its_index(spark, tmp_path, capsys):
    docs = documents(spark)
    index = Collection.create(docs, f"{tmp_path}/i", lambda: HashProvider(32), part_docs=60)
    mine = docs.where("collection_name = 'c'")
    plain = Memory(mine, hash_embed(mine, 32, text="vector_text"), HashProvider(32))
    memory = index.memory("c")
    shown = lambda m, **options: [(r["doc_id"], round(r["rerank_score"], 6)) for r in m.search("price weather", limit=6, **options)[0].collect()]
    for options in ({}, {"doc_types": ["episode_card"], "categories": ["a"], "participants": ["u1"]}):
        want = shown(plain, **options)
        assert want and shown(memory, **options) == want
    assert shown(index.memory("c", probes=99), **options) == want  # all cells
    # The lexical branch reads postings.
    lexical = index.memory("c")
    lexical.provider = None
    assert shown(lexical) == shown(Memory(mine)) and lexical.candidates("price")[1]
    near = gram_index.candidates(index.postings(), ["price"])
    assert "PushedFilters: [IsNull(__mark), Or(" in plan_of(near, capsys) or "EqualTo(gram" in plan_of(near, capsys)


def test_faults_of_the_plan_are_not_answered_degraded(spark):
    from pyspark.errors import AnalysisException

    docs = documents(spark, 20)
    with pytest.raises(AnalysisException):
        Memory(docs, docs.select("doc_id"), HashProvider(8)).search("price")


def test_gram_parts_split_hot_grams(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same words " + str(i), str(i)) for i in range(200)], "doc_id int, text string, item_key string")
    gram_index.write_index(docs, f"{tmp_path}/g", part_docs=20)
    index = gram_index.read_index(spark, f"{tmp_path}/g")
    spread = index.where("gram = 'the'").groupBy("part").count().collect()
    assert len(spread) == 10 and max(r["count"] for r in spread) < 60
    assert sorted(r["doc_id"] for r in gram_index.candidates(index, ["words 17"]).collect() if r["doc_id"] in (17, 170, 18)) == [17, 170]


# Items, jobs and chunks.


def test_grams_are_cut_without_a_lambda_for_each_letter(spark, capsys):
    texts = ["", "ab", "abc", "ABCabc", "naïve \U0001f600\U0001f601x", "İK\u212aß", None, "涨价人涨价人"]
    docs = spark.createDataFrame([(i, str(i % 3), t) for i, t in enumerate(texts)], "doc_id long, item_key string, text string")
    rows = gram_index.postings(docs, 2)
    low = [(t or "").replace("\u212a", "\x01").replace("İ", "\x01").lower() for t in texts]
    assert sorted((r["doc_id"], r["gram"]) for r in rows.collect()) == sorted((i, g) for i, t in enumerate(low) for g in {t[j : j + 3] for j in range(len(t) - 2)})
    plan = plan_of(rows, capsys)
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_library_replaces_all_kinds_at_once(spark, tmp_path):
    items = spark.createDataFrame([(f"i{k}", f"t{k}") for k in range(8)], "item_key string, title string")
    jobs = spark.createDataFrame([(f"i{k}", f"j{k}{n}", "old", "done" if n else None) for k in range(8) for n in range(3)], "item_key string, job_id string, title string, status string")
    chunks = spark.createDataFrame([(f"i{k}", f"c{k}{s}", s, "old") for k in range(8) for s in ("content", "transcript")], "item_key string, chunk_id string, source string, text string")
    held = library.Library.create(items, jobs, chunks, f"{tmp_path}/l", ("status",), bucket_items=3)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmp_path}/l") for f in fs if f.endswith(".parquet")}
    before = files()
    new_jobs = spark.createDataFrame([("i1", "j10", "new", "pending"), ("i1", "j11", "new", "pending"), ("i1", "j19", "new", "pending")], "item_key string, job_id string, title string, status string")
    new_chunks = spark.createDataFrame([("i1", "c1x", "content", "new"), ("i1", "c1y", "transcript", "not a snapshot's")], "item_key string, chunk_id string, source string, text string")
    assert held.replace(items.where("item_key = 'i1'").withColumn("title", F.lit("new")), new_jobs, new_chunks) == 3
    assert {r["title"] for r in held.items().where("item_key = 'i1'").collect()} == {"new"} and held.items().count() == 8
    assert {(r["job_id"], r["title"], r["status"]) for r in held.jobs().where("item_key = 'i1'").collect()} == {("j10", "new", None), ("j11", "new", "done"), ("j19", "new", "pending")}
    assert {(r["chunk_id"], r["text"]) for r in held.chunks().where("item_key = 'i1'").collect()} == {("c1x", "new"), ("c1transcript", "old")}
    assert held.jobs().where("item_key <> 'i1'").count() == 21 and held.chunks().count() == 16
    assert len(before.items() & files().items()) > 0
    # An item without jobs and chunks any more.
    held.replace(items.where("item_key = 'i2'"), new_jobs.limit(0), new_chunks.limit(0))
    assert held.jobs().where("item_key = 'i2'").count() == 0 and [r["source"] for r in held.chunks().where("item_key = 'i2'").collect()] == ["transcript"]
    state = lambda: sorted(map(str, held.items().collect() + held.jobs().collect() + held.chunks().collect()))
    was = state()
    with pytest.raises(Exception, match="lost"):
        held.replace(items.where("item_key = 'i3'"), new_jobs.limit(0), chunks.where("item_key = 'i3'").withColumn("text", F.raise_error(F.lit("lost")).cast("string")))
    assert state() == was
    held.replace_chunks(spark.createDataFrame([("i3", "n", "transcript", "said")], "item_key string, chunk_id string, source string, text string"), "transcript")
    assert {r["chunk_id"] for r in held.chunks().where("item_key = 'i3'").collect()} == {"n", "c3content"}


# Writers.


class Scripted:
    """Votes, and summaries of what it is asked; fails for episodes named so."""

    def __init__(self, place=None):
        self.place = place

    def complete(self, prompt):
        if self.place:
            with open(os.path.join(self.place, str(random.random())), "w") as f:
                f.write(prompt)
        if "Episode: fails" in prompt:
            raise TimeoutError("late")
        if "boundaries" in prompt:
            ends = [int(line.split(":")[0]) for line in prompt.splitlines() if "END" in line]
            return "I think " + json.dumps({"boundaries": [*ends, 9999]})
        return json.dumps({"scene_title": "S", "summary": prompt[-20:], "memory_clues": ["a", "a", ""]})


def test_writer_votes_and_is_asked_once(spark, tmp_path):
    place = tmp_path / "asked"
    place.mkdir()
    answers = writing.Answers(spark, f"{tmp_path}/answers", lambda: Scripted(str(place)))
    said = lambda n, ends: [(i, f"said {i}" + (" END" if i in ends else ""), i * 20_000, i * 20_000 + 19_000) for i in range(n)]
    rows = [("one", "T", said(10, {4})), ("many", "U", said(30, {6, 12, 20})), ("fails", "fails", said(10, {4})), ("none", "V", [])]
    atoms = spark.createDataFrame(rows, "item_key string, item_title string, atoms array<struct<idx:int,text:string,start_ms:long,end_ms:long>>")
    got, asked = writing.voted_scenes(answers, atoms)
    found = {r["item_key"]: r["scenes"] for r in got.collect()}
    assert found["one"] == [list(range(5)), list(range(5, 10))] and found["fails"] == [list(range(8)) + [8, 9]] and found["none"] == []
    assert asked == len(list(place.iterdir())) == 1 + 3 + 1
    # 12 stands in two windows; 6 and 20 in one each, so they have no majority.
    assert 12 in {s[-1] for s in found["many"]} and 6 not in {s[-1] for s in found["many"]}
    # Only what failed is asked again, three times in all.
    assert [writing.voted_scenes(answers, atoms)[1] for _ in range(3)] == [1, 1, 0]
    episodes = spark.createDataFrame([("one", "T", "ex", None, ["t"], ["s1", "s2"], ["x1", "x2"], ["n"]), ("fails", "fails", "", "", [], ["s1", None], ["x1", "x2"], [])], "item_key string, title string, excerpt string, desc string, tags array<string>, scene_titles array<string>, scene_texts array<string>, note_titles array<string>")
    out, asked = writing.episode_summaries(answers, episodes)
    by = {r["item_key"]: r for r in out.collect()}
    assert asked == 2 and by["one"]["by_writer"] and by["one"]["summary"]["memory_clues"] == ["a"] and by["one"]["summary"]["summary"].endswith("s2\nx2")
    assert not by["fails"]["by_writer"] and by["fails"]["summary"]["scene_title"] == "fails" and by["fails"]["summary"]["summary"] == "s1"
    assert writing.episode_summaries(answers, episodes, allow_fallback=False)[0].where("item_key = 'fails'").first()["summary"] is None
    assert writing.episode_summaries(answers, episodes)[1] == 1


# Words, options, times.


def test_merged_terms_against_a_loop(spark):
    from tidepool.functions.terms import term

    rng = random.Random(2)
    rows = [(str(j), g, n, rng.choice(["AIR", " two  words", "AIR ", "x", "12", "广告", "漢字", "__", "http://a", "rail", None])) for j in range(30) for g in (0, 1) for n in range(rng.randrange(9))]
    want = {}
    for j, _, _, t in sorted(rows, key=lambda r: r[:3]):
        if (t := term(t)) and t not in want.setdefault(j, []):
            want[j].append(t)
    want = {j: t[:3] for j, t in want.items() if t}
    lists = spark.createDataFrame(rows, "job_id string, list int, nth int, term string")
    assert {r["job_id"]: r["terms"] for r in records.merged_terms(lists, 3).collect()} == want
    own = spark.createDataFrame([("a", ["AIR", "b", "two  words"]), ("b", None)], "job_id string, terms array<string>")
    assert {r["job_id"]: r["terms"] for r in records.job_terms(own, ["two words", "rail", "AIR"], 3).collect()} == {"a": ["AIR", "two words", "rail"], "b": ["two words", "rail", "AIR"]}


def test_filter_options_in_order_of_a_chinese_reader(spark):
    counts = spark.createDataFrame([("张三", 3), ("李四", 3), ("王五", 3), ("阿一", 3), ("many", 9), ("chosen", 1), (None, 3)], "name string, n int")
    assert [r["name"] for r in stats.filter_options(counts, ["chosen", "nobody"]).collect()] == ["chosen", "many", None, "阿一", "李四", "王五", "张三"]  # a, li, wang, zhang


def test_library_updated_at(spark, tmp_path):
    root = str(tmp_path)
    assert readers.library_updated_at(spark, root) is None and readers.library_updated_at(spark, root, {"built_at": " 2024 "}) == "2024"
    (tmp_path / "reports").mkdir()
    (tmp_path / "catalog.sqlite").write_bytes(b"\x00\x01")
    os.utime(tmp_path / "catalog.sqlite", (1_700_000_000, 1_700_000_000))
    assert readers.library_updated_at(spark, root) == "2023-11-14T22:13:20+00:00"
    (tmp_path / "reports/daily_incremental_summary.json").write_text("﻿" + '{"library_updated_at": " ",\n "built_at": "2025-01-01"}', encoding="utf-8")
    assert readers.library_updated_at(spark, root, {"library_updated_at": ""}) == "2025-01-01"
    (tmp_path / "reports/search_release_meta.json").write_text("not json")
    os.utime(tmp_path / "reports/search_release_meta.json", (1_600_000_000, 1_600_000_000))
    assert readers.library_updated_at(spark, root) == "2020-09-13T12:26:40+00:00"


# Logs and streams.


def test_audit_log_is_idempotent_and_rotated(spark, tmp_path):
    at = f"{tmp_path}/log"
    rows = lambda n: spark.createDataFrame([(f"2024-01-01T00:00:{n:02d}", f"q{n}")], "timestamp string, query string")
    write = audit.append(at)
    for n in (0, 1, 1, 2, 0):
        write(rows(n), n)
    assert [r["query"] for r in audit.entries(spark, at).collect()] == ["q0", "q1", "q2"]
    one = audit.sizes(spark, at)[0][1]
    audit.append(at, most_bytes=one, kept=1)(rows(3), 3)
    assert [r["query"] for r in audit.entries(spark, at).collect()] == ["q2", "q3"]
    ip = spark.range(1).select(audit.client_ip(F.lit(" 1.1.1.1, 2.2.2.2"), F.lit("3"), F.lit("4")).alias("a"), audit.client_ip(F.lit(None), F.lit(" 3 "), F.lit("4")).alias("b"), audit.client_ip(F.lit(" "), F.lit(None), F.lit("4")).alias("c")).first()
    assert tuple(ip) == ("1.1.1.1", "3", "4")


def test_fetcher_waits_longer_each_time(spark):
    waits, calls = [], []

    def get(path, params):
        calls.append(path)
        if len(calls) < 3:
            raise ConnectionError("refused")
        return 200, "application/json", '{"a": 1}'

    assert paged_stream.Fetcher(get, 3, 2.0, waits.append).json("x") == {"a": 1} and waits == [2.0, 4.0]
    with pytest.raises(paged_stream.Unfetched, match="refused"):
        paged_stream.Fetcher(lambda p, q: (_ for _ in ()).throw(ConnectionError("refused")), 2, 0, waits.append).json("x")
    for answer, told in (((500, "text/html", "<b>"), "status 500"), ((200, "text/html", "<b>"), "expected JSON"), ((200, "application/json", "{"), "invalid JSON")):
        with pytest.raises(paged_stream.Unfetched, match=told):
            paged_stream.Fetcher(lambda p, q, a=answer: a).json("x")
    assert paged_stream.list_params(5, 10, "-at") == {"page[limit]": 5, "page[offset]": 10, "sort": "-at"}


def test_list_of_unknown_length_is_read_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def get(path, params):
        rows = [{"id": i} for i in range(23)][params["page[offset]"] :][: params["page[limit]"]]
        if rows:
            with open(asked, "a") as f:
                f.write(f"{params['page[offset]']}\n")
        return 200, "application/json", json.dumps({"data": rows})

    source = paged_stream.list_stream("tidepool_test_list", "id long", paged_stream.Fetcher(get), lambda page: [(r["id"],) for r in page["data"]])
    spark.dataSource.register(source)

    def run():
        q = spark.readStream.format("tidepool_test_list").option("path", "radios").option("limit", 5).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()

    run()
    assert [int(x) for x in open(asked)] == [0, 5, 10, 15, 20]
    run()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(23))


def test_a_batch_of_a_list_has_many_pages(monkeypatch):
    asked, failing = [], set()

    def fetch(at, n):
        asked.append((at, n))
        if at in failing:
            raise paged_stream.Unfetched("no page")
        return [(i,) for i in range(23)][at : at + n]

    reader = paged_stream.PageReader(fetch, 5)
    rows, end = reader.read({"at": 0})
    assert (list(rows), end) == ([(i,) for i in range(23)], {"at": 23}) and asked == [(at, 5) for at in (0, 5, 10, 15, 20)]
    assert (list(reader.read(end)[0]), reader.read(end)[1]) == ([], end)
    asked.clear()
    assert list(reader.readBetweenOffsets({"at": 5}, {"at": 23})) == [(i,) for i in range(5, 23)] and asked == [(5, 5), (10, 5), (15, 5), (20, 3)]
    monkeypatch.setattr(paged_stream, "BATCH_PAGES", 2)
    assert reader.read({"at": 5})[1] == {"at": 15} and reader.read({"at": 15})[1] == {"at": 23}
    failing.add(10)
    assert reader.read({"at": 5})[1] == {"at": 10}  # what came before the failure isn't lost
    with pytest.raises(paged_stream.Unfetched):
        reader.read({"at": 10})


def test_many_ties_of_a_mark_are_joined(spark, capsys):
    rows = spark.createDataFrame([(i // 5, i % 5, str(100 - i), "2024-01-02" if i < 30 else "2024-01-01") for i in range(60)] + [(12, 0, "500", None)], "page int, nth int, item_id string, published_at string")
    pages, known = (lambda a, b: rows.where((F.col("page") >= a) & (F.col("page") < b))), rows.where("item_id % 7 <> 0 OR page > 7")
    few = tuple(r["item_id"] for r in rows.where("item_id % 3 = 0 AND published_at = '2024-01-02'").collect())
    marks = [crawl.Mark("2024-01-02", ties) for ties in (few, spark.createDataFrame([(t,) for t in few * 2], "item_id string"), (), spark.createDataFrame([], "item_id string"))]
    got = [[sorted(map(tuple, crawl.sync_latest(pages, known, m, block=2)[0].collect())), crawl.sync_latest(pages, known, m, block=2)[1]] for m in marks]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2] and 30 < len(got[0][0]) < 61
    out, _ = crawl.sync_latest(pages, known, marks[1], block=2)
    assert "Join" not in plan_of(out, capsys)  # each block was worked out once


def test_numbers_of_a_list_without_one_task(spark, capsys):
    rows = spark.range(500).withColumn("v", F.col("id") % 7).repartition(6)
    got = {r["id"]: r["at"] for r in crawl.numbered(rows, F.desc("v"), F.asc("id")).collect()}
    want = {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert got == want


def build(item_key, payload):
    if '"bad"' in payload:
        raise ValueError("cannot build")
    return json.dumps([{"doc_id": f"{item_key}:card", "text": json.loads(payload)["text"]}])


def test_bridge_goes_on_after_a_restart(spark, tmp_path):
    results, log, state, dead = (str(tmp_path / x) for x in ("results", "log", "state", "dead"))
    os.mkdir(results)
    put = lambda name, **p: open(f"{results}/{name}.json", "w").write(json.dumps(p))  # noqa: E731, SIM115
    merged = []
    saved = {k: spark.conf.get(k, None) for k in bridge.STATE_SETTINGS}
    for k, v in bridge.STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:

        def run(until):
            out = bridge.outcomes(spark, log, build, bridge.Policy(base=0.05, most=0.2, tries=2), files=2)
            q = out.writeStream.outputMode("update").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").foreachBatch(bridge.sink(lambda rows: merged.extend(tuple(r) for r in rows.collect()), dead)).start()
            end = time.time() + 90
            while not until() and time.time() < end:
                time.sleep(0.2)
                assert q.exception() is None
            q.stop()

        for k in range(4):
            put(f"r{k}", item_key=f"i{k}", text=f"v{k}")
        put("r8", item_key="i8", kind="bad")
        put("r9", text="no key")
        bridge.poll(spark, results, log)
        run(lambda: len(merged) >= 2)  # stopped in the middle
        lost = lambda: spark.read.parquet(dead).collect() if glob.glob(f"{dead}/batch=*/*.parquet") else []
        bridge.poll(spark, results, log)
        run(lambda: len({m[0] for m in merged}) >= 4 and len(lost()) >= 2)
        assert sorted((m[0], json.loads(m[2])[0]["text"]) for m in set(merged)) == [(f"i{k}", f"v{k}") for k in range(4)]
        assert {(r["item_key"], r["tries"], r["status"]) for r in lost()} == {("i8", 2, "dead"), (None, 2, "dead")}
        n = len(merged)
        time.sleep(0.01)
        put("r1", item_key="i1", text="changed")
        bridge.poll(spark, results, log)  # all files are listed again; one has another signature
        run(lambda: len(merged) > n)
        assert [json.loads(m[2])[0]["text"] for m in merged[n:]] == ["changed"]
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Settings, bundles, repairs.


def test_index_config(spark, tmp_path):
    from tidepool.plans.config import IndexConfig

    (tmp_path / "aliases").write_text('{"a  b": "c",\n "x": "x"}')
    assert IndexConfig(alias_map_path=f"{tmp_path}/aliases").aliases(spark, {"d": "e"}) == {"a b": "c", "d": "e"} and IndexConfig().aliases(spark) == {}
    assert len(IndexConfig(embedding_dimension=12).make()().one("x")) == 12
    for wrong in ({"summary_mode": "x"}, {"embedding_dimension": 2}):
        with pytest.raises(ValueError):
            IndexConfig(**wrong)


def test_bundle_has_its_ui_meta(spark, tmp_path):
    from tidepool.sources import sinks

    docs = documents(spark).withColumn("doc_type", F.when(F.col("doc_type") == "timeline_note", "item_title").otherwise(F.col("doc_type")))
    meta = Memory(docs.where("collection_name = 'c'")).ui_meta("2024", participants_limit=1)
    assert meta["participants"] == [{"name": "N", "n": meta["doc_type_counts"]["item_title"]}] and meta["participants_count"] == 4 and meta["program_types_count"] == 1 and meta["eligible_items"] > 0
    more = {"app_min_version": "1.10", "data_version": "1", "built_at": "x", "collection_name": "c", "query_only": True, "doc_type_counts": {}, "eligible_items": 1, "embedding_provider": "hash", "embedding_model": "", "target_platform": " Linux "}
    manifest = sinks.export_bundle(docs, hash_embed(docs, 8, text="vector_text"), "c", f"{tmp_path}/b", ui_meta=meta, **more)
    assert json.load(open(tmp_path / "b/ui_meta.json")) == json.loads(json.dumps(meta)) == readers.snapshot(spark, f"{tmp_path}/b/ui_meta.json")
    assert sinks.viewer_faults(manifest, "1.10.1", "linux") == [] and sinks.viewer_faults(manifest, "1.9", "windows") == ["version 1.9 is below 1.10", "made for linux, not for windows"]
    assert len(sinks.viewer_faults({}, "1", "linux")) == 10


def test_repaired_transcripts_are_cut_anew(spark):
    from tidepool.operators.states import repaired_transcripts

    rng = random.Random(1)
    good = ["".join(chr(rng.randrange(0x4E00, 0x5400)) for _ in range(30)) + "。" for _ in range(60)]
    segment = "array<struct<start_ms:long,end_ms:long,text:string,asr_confidence:double>>"
    rows = [("t1", "i1", "\n".join([*good, "<unk>"]), [(i, i + 1, t, 0.9) for i, t in enumerate([*good, "<unk> <unk>"])]), ("t2", "i1", "x", [(0, 1, "fine words here", 0.9)]), ("t3", "i2", None, None)]
    saved, chunks, refused = repaired_transcripts(spark.createDataFrame(rows, f"transcript_id string, item_key string, text string, segments {segment}"), 400)
    one = saved.collect()
    assert {r["transcript_id"]: r["refused"] for r in refused.collect()} == {"t2": "nothing removed", "t3": "no segments"}
    assert [(r["transcript_id"], r["removed"]) for r in one] == [("t1", 1)] and "<unk>" not in one[0]["text"] and len(one[0]["segments"]) == 60
    cut = chunks.orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in cut] == list(range(len(cut))) and max(len(r["text"]) for r in cut) <= 400 and "".join(r["text"] for r in cut).replace("\n", "") == one[0]["text"].replace("\n", "")
    assert {r["transcript_id"]: r["refused"] for r in refused.collect()} == {"t2": "nothing removed", "t3": "no segments"}


def test_commands_of_a_collection(spark, tmp_path, capsys):
    from tidepool.__main__ import main

    docs = documents(spark, 60, 12)
    docs.where("item_key <> '3'").write.parquet(f"{tmp_path}/docs")
    docs.where("item_key = '3'").write.parquet(f"{tmp_path}/more")
    docs.where("item_key = '3'").select("collection_name", "item_key").write.parquet(f"{tmp_path}/items")
    main(["create-collection", f"{tmp_path}/docs", f"{tmp_path}/c", "--dimension", "32"])
    capsys.readouterr()
    main(["sync-collection", f"{tmp_path}/c", f"{tmp_path}/more", f"{tmp_path}/items", "--dimension", "32"])
    assert json.loads(capsys.readouterr().out)["embedded"] == 5
    main(["find", f"{tmp_path}/c", "c", "price", "--limit", "3", "--dimension", "32", "--probes", "2"])
    found = json.loads(capsys.readouterr().out)
    assert not found["degraded"] and len(found["results"]) == 3
    (tmp_path / "lib").mkdir()
    main(["library-updated", f"{tmp_path}/lib"])
    assert capsys.readouterr().out.strip() == "null"
