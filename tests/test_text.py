import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.functions import embed, terms, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "query, clue",
    [
        ("我记得聊过涨价和行业压力的那期", "涨价和行业压力"), ("不能结婚的男人", "不能结婚的男人"), ("应用商店", "应用商店"), ("如何用人工智能做游戏", "如何用人工智能做游戏"),
        ("节目制作", "节目制作"), ("《我记得》", "我记得"), ("我记得", "我记得"), ("我记得 Nadya 聊过游科和 ROG 的那一期", "Nadya"), ("我记得 Nadya 聊过游科和 ROG 的那一期", "ROG"),
    ],
)
def test_query_clues(query, clue):
    assert clue in terms.query_terms(query)


def test_query_terms_leave_out_memory_phrases():
    found = terms.query_terms("我记得聊过涨价和行业压力的那期")
    assert {"涨价", "行业压力"} <= set(found) and not {"我记", "记得", "聊过", "那期"} & set(found)
    assert terms.clue("我记得聊过涨价和行业压力的那期") == "涨价和行业压力"
    assert terms.recall_terms([" a ", "ab", "ab", "abc"], 2) == ["ab", "abc"]
    assert terms.scope_doc_types("content", ["episode_card"]) == ["episode_card"] and terms.scope_doc_types("title", ["x"]) == ["item_title"]
    assert terms.term("12345") is None and terms.term("http://x.y") is None and terms.term("——") is None and terms.term(" a  b ") == "a b"


def test_normalising(spark):
    assert one(spark, " a　 b\r\nc ", text.normalize) == "a b c" and one(spark, None, text.normalize) == ""
    assert one(spark, " a \r\n\r\n b　\rc", text.normalize_lines) == "a\nb\nc"
    assert one(spark, "Äa A", text.fold_ascii) == "Äa a"


@pytest.mark.parametrize("value, term, want", [("100%_done", "100%_", True), ("100xxdone", "100%_", False), ("PRICE up", "price", True), ("É", "é", False), ("é", "É", False), ("\u212a", "k", False), ("\u0130x", "i", False), ("涨价ROG", "价rog", True), (None, "a", False)])
def test_contains_is_literal(spark, value, term, want):
    assert one(spark, value, lambda c: text.contains_term(c, term)) is want


def test_flags(spark):
    assert one(spark, "哈" * 14, text.is_low_signal) and one(spark, "?! ...", text.is_low_signal) and not one(spark, "hello", text.is_low_signal)
    assert one(spark, "a" * 12, text.quality_flags) == ["repeated_chars", "short"] and one(spark, "", text.quality_flags) == ["empty", "short"]
    assert one(spark, "x", text.repetition_reason) is None and one(spark, "  ", text.repetition_reason) == "empty"
    assert one(spark, "ab" * 100, text.repetition_reason) == "low_unique_ratio" and one(spark, "abcdefgh" * 20 + "z" * 30, text.repetition_reason) == "char_run"
    assert one(spark, " ".join(["one"] * 30 + [f"w{i}" for i in range(30)]), text.repetition_reason) == "token_ratio"


def greedy(units, width):
    done, now = [], ""
    for u in units:
        if len(u) > width:
            done += [now] if now else []
            done += [s.strip() for s in (u[i : i + width] for i in range(0, len(u), width)) if s.strip()]
            now = ""
        elif not now or len(now) + 1 + len(u) <= width:
            now = f"{now}\n{u}" if now else u
        else:
            done, now = [*done, now], u
    return done + ([now] if now else [])


def test_packing_against_a_loop(spark):
    rng = random.Random(1)
    cases = [["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u array<string>").select("i", text.pack_chunks(F.col("u"), 20).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: greedy(c, 20) for i, c in enumerate(cases)}


def test_segment_chunks(spark):
    frame = spark.createDataFrame([("T", "E", "第一句。第二句！" * 60), ("T", None, None), (None, None, None)], "t string, e string, b string")
    got = [r.c for r in frame.select(text.segment_chunks([F.col("t"), F.col("e")], [F.col("b")], 230).alias("c")).collect()]
    assert all(c.startswith("T\nE\n\n") and len(c) <= 230 for c in got[0]) and got[1] == ["T"] and got[2] == []
    assert one(spark, "a。b!c\n\nd", text.sentence_units) == ["a。", "b!", "c", "d"]


def test_excerpt_and_time(spark):
    body = "x" * 100 + "needle" + "y" * 300
    got = one(spark, body, lambda c: text.excerpt(c, F.array(F.lit("absent"), F.lit("needle"))))
    assert got == "..." + body[40:280] + "..." and one(spark, "abc", lambda c: text.excerpt(c, F.array(F.lit("z")))) is None
    assert one(spark, "a" * 200, lambda c: text.excerpt(c, F.array(F.lit("z")), head=F.lit(True))) == "a" * 180 + "..."
    assert [one(spark, v, text.format_ms, "long") for v in (0, 61_000, 3_661_999, -5, None)] == ["00:00", "01:01", "01:01:01", "00:00", "00:00"]


def test_errors_and_plans(spark):
    want = {"Bad allocation x": "bad_allocation", "a CUDA error": "cuda_error", "x/('y', 1.0, 2)": "hallucinated_repeat_token", "did not contain text": "empty_output", None: "other"}
    assert {m: one(spark, m, text.classify_error) for m in want} == want
    plan = lambda c, s: one(spark, c, lambda x: text.rescue_plan(x, F.lit(s)))
    assert plan("bad_allocation", 1).strategy == "chunked" and plan("hallucinated_repeat_token", 1800).chunk_seconds == 300 and plan("cuda_error", 1).reset_before
    assert plan("other", 3600).priority == 1 and plan("other", 10).priority == 3 and one(spark, "CUBLAS failed", text.is_recoverable)


def test_stitch_and_extension(spark):
    assert one(spark, ["hello wor", "world and", " ", "xyz"], text.stitch, "array<string>") == "hello world andxyz"
    ext = lambda u, a, m: one(spark, u, lambda c: text.guess_extension(c, F.lit(a), F.lit(m)))
    assert [ext("http://a/b.MP3?x=.y", "audio_url", "audio"), ext("http://a/b.m3u8", "m3u8", "vod"), ext(None, "play_auth", "x"), ext("http://a/b", "asset_url", "x"), ext("http://a/b", "q", "x")] == [".mp3", ".mp4", ".json", ".asset", ".bin"]


def test_drop_segment(spark):
    drop = lambda t, i, n, c: one(spark, t, lambda x: text.drop_segment(x, F.lit(i), F.lit(n), F.lit(c).cast("double")))
    assert drop("", 50, 100, None) and drop("a <unk> b", 50, 100, None) and drop("oh yeah", 0, 100, None) and not drop("oh yeah", 50, 100, None)
    assert drop("some long english words here", 99, 100, 0.5) and not drop("some long english words here", 99, 100, 0.95)


def test_hash_embedding_twins(spark):
    rows = [(1, "玩ROG游戏 hello hello"), (2, ""), (3, None)]
    got = {r.doc_id: list(r.embedding) for r in embed.hash_embed(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(embed.HashProvider(64).one(t or ""), abs=1e-6)
    by = embed.embed_with(spark.createDataFrame(rows, "doc_id long, text string"), lambda: embed.HashProvider(64))
    assert all(list(r.embedding) == pytest.approx(got[r.doc_id], abs=1e-6) for r in by.collect())
    with pytest.raises(ValueError):
        embed.provider("unknown")
    assert re.fullmatch(r"0\.\d+|1\.0+\d*", f"{one(spark, [1.0, 1.0], lambda c: embed.cosine(c, F.array(F.lit(1.0), F.lit(0.0))), 'array<double>'):.6f}")


def test_hash_embedding_shuffles_no_texts_and_merges_equal_keys(spark, capsys):
    said = "abc de_f 你好 abc x/y " * 3
    rows = [(i, said + str(i)) for i in range(40)] + [(40, ""), (41, None), (42, "!?")]
    plain = embed.hash_embed(spark.createDataFrame(rows, "doc_id long, text string"), 16)
    plain.explain()
    assert "Exchange" not in capsys.readouterr().out
    more = [*rows, (3, "more words"), (3, None), (41, "late"), (None, "a"), (None, "b c"), *[(7, "hot") for _ in range(50)]]
    whole = {}
    for k, t in more:
        whole[k] = f"{whole.get(k, '')} {t or ''}"
    got = [(r.doc_id, list(r.embedding)) for r in embed.hash_embed(spark.createDataFrame(more, "doc_id long, text string").repartition(5), 16).collect()]
    assert len(got) == len(whole) and all(v == pytest.approx(embed.HashProvider(16).one(whole[k]), abs=1e-6) for k, v in got)
