"""The stages on fixtures, each held against brute force, and the whole run."""

from collections import Counter

import corpus_pipeline
from tests.llm.helpers import clashing, docs
from tests.llm.test_operators import brute_classes, brute_hits, brute_print
from tidepool.llm.tables import stored, table


def test_stages(spark, sf_dir):
    frame = table(spark, sf_dir, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    now, columns = frame, frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = stored(stage(spark, now, sf_dir))
        after = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "language":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_dedup":
            classes = brute_classes([(i, brute_print(r.text)) for i, r in sorted(before.items())])
            assert set(after) == set(classes.values()) and max(after.values()) == 1
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, bench)[3]}
        if name == "mixing":
            assert max(after.values()) <= 2 and set(after) <= set(before)
        if name != "sharding":
            assert out.columns == columns
        else:
            assert out.columns == [*columns, "shard"] and set(after) == set(before)
        now = out


def test_language_rejects_unlearned(spark, sf_dir):
    learned = table(spark, sf_dir, "documents")
    other = [
        (10**9, "Съешь же ещё этих мягких французских булок, да выпей чаю. Все люди рождаются свободными и равными."),
        (10**9 + 1, "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"),
        (10**9 + 2, "xqzv kjwq zzxv qqwk vvkx jjqz wxkq vzjx kqqz"),
    ]
    out = corpus_pipeline.language(spark, learned.unionByName(docs(spark, [(i, t, None) for i, t in other])), sf_dir)
    got = {r.doc_id for r in out.collect()}
    assert not got & {i for i, _ in other}
    assert got == {r.doc_id for r in learned.collect() if any(c.isalpha() for c in r.text or "")}


def test_run_on_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "1 2 3"), (None, "no id here at all"), *[(i, f"some words of text number {i} and {i * i} more {'abc' * i}") for i in range(4, 40)], (5, "twice"), (5, "twice"), (99, "a long text of many words " * 20_000)]
    clashing(docs(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in out.collect()}
    assert not got & {1, 2, 3} and 99 in got and out.where("shard < 0 or shard > 39").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
