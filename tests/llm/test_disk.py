"""What operators leave on disk and send through shuffles."""

import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from outturn.llm import jaccard
from outturn.llm.common import staged


def test_shuffle_files_go_with_their_job(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for k in range(blocks.size()) if (name := blocks.apply(k).toString()).startswith("shuffle_")}

    before = shuffled()
    rows = staged(spark.range(20_000).groupBy((F.col("id") % 7_001).alias("k")).count(), "counts")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and rows.count() == 7_001


def test_keys_that_the_same_sets_share_count_once(spark, monkeypatch):
    # twenty passages, each in two texts that are no near copies
    texts = [" ".join([*(f"p{i // 2}-{k}" for k in range(280)), *(f"u{i}-{k}" for k in range(120))]) for i in range(40)]
    met = []

    def counted(df, label):
        out = staged(df, label)
        met.extend([out.count()] if label == "met" else [])
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.near_copies(docs, percent=80, n=5).collect()
    assert met == [40] and all(r["component_id"] == r["doc_id"] for r in rows)


def test_ids_of_any_size_meet(spark):
    text = " ".join(f"w{k}" for k in range(60))
    ids = [-(2**62), -5, 3, 2**62]  # too far apart for four bytes
    texts = [text, text + " more", text.replace("w0 ", "other "), "alone " + text[::-1]]
    rows = jaccard.near_copies(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {ids[0]: ids[0], ids[1]: ids[0], ids[2]: ids[0], ids[3]: ids[3]}


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    texts = [" ".join(f"w{i // 2 if i < 20 else i}-{k}" for k in range(30)) for i in range(200)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
        ids = [r["doc_id"] for r in kept.collect()]
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(ids) == [*range(0, 20, 2), *range(20, 200)] and plan.startswith("Union")


def test_large_sets_that_share_a_passage_are_not_paired(spark, monkeypatch):
    # every text has 980 of its 1,400 words from one passage: sets of many more shingles than a short sketch has bits
    texts = [" ".join([*(f"p{k}" for k in range(980)), *(f"u{i}-{k}" for k in range(420))]) for i in range(12)]
    met = {}

    def counted(df, label):
        out = staged(df, label)
        met.setdefault(label, out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.near_copies(docs, percent=80, n=5).collect()
    assert met["met"] > 0 and met["pairs"] == met["more"] == met["tried"] == 0
    assert all(r["component_id"] == r["doc_id"] for r in rows)


def test_blocks_of_a_large_group_meet_each_other(spark, monkeypatch):
    draw = random.Random(5)
    texts = []
    for of in range(3):
        base = [f"b{of}-{k}" for k in range(150 + 400 * of)]
        for i in range(25):
            words, start = list(base), draw.randrange(len(base) // 2)
            for k in range(start, start + int(len(base) * draw.choice([0.03, 0.08, 0.11, 0.15]))):
                words[k] = f"v{of}-{i % 9}-{k}"
            texts.append(" ".join(words))
    sets = [set(jaccard.shingles(t, 5).tolist()) for t in texts]
    least = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(jaccard, "CELL", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.near_copies(docs, percent=80, n=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(least))
