"""The pipeline stage by stage against what each stage has to do, and its registered query."""

import corpus_pipeline
import sentencepiece
from test_operators import brute_components, brute_hits

from outturn.llm import private, toxicity
from outturn.llm.common import staged, table
from outturn.llm.queries import model_path


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs.orderBy("doc_id").collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, sf_dir), "test")
        rows = docs.orderBy("doc_id").collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 0:
            scores = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
            bad = {r["doc_id"] for r in scores if r["predicted"]}
            assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in kept if r["doc_id"] not in bad]
        elif k == 1:
            groups = brute_components([r["text"] for r in kept], 80, 5)
            assert [r["doc_id"] for r in rows] == [r["doc_id"] for i, r in enumerate(kept) if groups[i][1] == i]
        elif k == 2:
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            hits = list(brute_hits([r["text"] for r in kept], items))
            assert [r["doc_id"] for r in rows] == [r["doc_id"] for r, h in zip(kept, hits, strict=True) if not h[1]]
        elif k == 3:
            assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in kept]
            assert not any(any(private.base_spans(r["text"] or "")) for r in rows)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=model_path())
            assert {r["doc_id"]: list(r["ids"]) for r in rows} == {r["doc_id"]: [*library.encode(r["text"] or ""), 2] for r in kept}
        kept = rows
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept)


def test_decisions_hold_for_null_and_repeated_ids(spark, sf_dir):
    """What goes, goes by its text: ids that are null or occur twice neither save a row nor take another one along."""
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    all_ = table(spark, sf_dir, "documents").where("doc_id >= 0")
    bad = {r["doc_id"] for r in toxicity.score_toxicity(all_, labels).collect() if r["predicted"]}
    texts = {r["doc_id"]: r["text"] for r in all_.collect()}
    toxic, clean = texts[min(bad)], next(t for d, t in sorted(texts.items()) if d not in bad and t and len(t.split()) > 50)
    passage = next(r["text"] for r in items.collect() if len(r["text"].split()) > 30)
    rows = all_.where(f"doc_id <> {min(bad)}")
    more = [(7, toxic), (7, clean), (None, toxic), (None, "a clean text of its own"), (8, passage + " more"), (None, passage), (8, "clean"), (8, None)]
    added = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    both = staged(rows.where("doc_id > 8").unionByName(added), "odd")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_toxic(spark, both, sf_dir).collect()]
    assert not [t for _, t in kept if t == toxic] and (7, clean) in kept and (None, "a clean text of its own") in kept
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_benchmark(spark, both, sf_dir).collect()]
    assert not [t for _, t in kept if t and passage in t] and (8, "clean") in kept and (8, None) in kept


def test_one_of_each_group_stays_whatever_its_ids(spark, sf_dir):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(None, a), (5, a + " end"), (3, a), (3, a), (1, b), (1, "blank is not"), (2, None), (4, ""), (2, None), (None, b), (None, "x y z"), (None, "x y z")]
    docs = staged(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "odd")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, docs, sf_dir).collect()), key=str)
    assert kept == sorted([(3, a), (1, b), (1, "blank is not"), (2, None), (2, None), (4, ""), (None, "x y z")], key=str)
    none = corpus_pipeline.one_of_near_copies(spark, docs.limit(0), sf_dir)
    assert none.columns == docs.columns and none.count() == 0
