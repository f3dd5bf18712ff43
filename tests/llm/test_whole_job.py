"""Cases in which an operator once did less than its whole job."""

import hashlib

import corpus_pipeline
import numpy as np
import sentencepiece
from test_operators import brute_components

from outturn.llm import lm, order
from outturn.llm.common import table
from outturn.llm.queries import QUERIES, model_path


def test_near_copy_stage_takes_five_words_and_four_fifths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.orderBy("doc_id").collect()
    groups = brute_components([r["text"] for r in rows], 80, 5)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for i, r in enumerate(rows) if groups[i][1] == i]


def test_training_order_holds_piece_ids(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = QUERIES["op3_training_order"](spark, sf_dir).orderBy("doc_id", "seq_no").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    expected = []
    for d in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = [*library.encode(d["text"] or ""), library.eos_id()]
        for k in range(0, len(ids), order.LENGTH):
            part = ids[k : k + order.LENGTH]
            record = np.array(part + [65535] * (order.LENGTH - len(part)), "<u2").tobytes()
            expected.append((d["doc_id"], k // order.LENGTH, len(part), hashlib.sha256(record).hexdigest()))
    assert [(r["doc_id"], r["seq_no"], r["n_ids"], r["ids_sha256"]) for r in rows] == expected


def test_ids_are_read_back_from_any_slot(spark, tmp_path):
    kind, path = order.Ids(4, 2, 2**32 - 1), str(tmp_path / "shards")
    docs = [(1, [70_000, 5, 6]), (2, []), (3, None), (4, list(range(100_000, 100_009)))]
    total = order.write_shards(spark.createDataFrame(docs, "doc_id long, ids array<int>"), path, 3, 4, 2, kind)
    rows = order.read_records(spark, path, 0, 4, 2, kind).orderBy("doc_id", "seq_no").collect()
    assert total == len(rows) == 6 and all(r["at"] == r["slot"] % 2 * 16 for r in rows)
    for doc, ids in docs:
        got = np.concatenate([kind.unpack(r["ids"]) for r in rows if r["doc_id"] == doc]).tolist()
        want = [*(ids or []), 2]
        assert got == want + [kind.pad] * (-len(want) % 4)
    assert {r["slot"] for r in order.read_records(spark, path, 3, 4, 2, kind).collect()} == {3, 4, 5}


def test_copies_of_an_id_in_several_tasks(spark, tmp_path, monkeypatch):
    texts = [f"{'x' * (k % 90)} {k}" for k in range(400)]
    docs = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "doc_id long, text string")
    numbered = order.numbered

    def dealt(*args):  # as a join read by mapper, or one split as skewed, leaves its rows
        rows, total = numbered(*args)
        return rows.repartition(16), total

    monkeypatch.setattr(order, "numbered", dealt)
    total = order.write_shards(docs, str(tmp_path / "shards"), 5, length=32, per_shard=16)
    rows = order.read_records(spark, str(tmp_path / "shards"), 0, 32, 16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    for d in range(3):
        body = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["seq_no"]) if r["doc_id"] == d)
        parts = sorted(p.lstrip(b"\xfe") for p in body.split(b"\xff") if p.strip(b"\xfe"))
        assert parts == sorted(t.encode() for k, t in enumerate(texts) if k % 3 == d)


def test_training_takes_every_span(spark):
    import pickle

    words, weight = [b"alpha", b"beta"], np.array([2.0, 1.0])
    names = lm.inventory(model_path(), words, weight)
    prior = lm.Prior(np.ones((lm.SIZE + 1, lm.SIZE + 1)), (*lm.spell(words, lm.Trie(names)), weight))
    texts = [None, "alpha", *(" ".join(["alpha beta"] * n) for n in (5, 31, 32, 33, 700))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = lm.training_spans(docs, names, spark.sparkContext.broadcast(pickle.dumps(prior))).collect()
    sizes = [len((t or "").split()) + 1 for t in texts]
    assert len(spans) == sum(-(-n // lm.SPAN) for n in sizes)
    whole = lm.Speller(lm.Trie(names), prior).ids([[*lm.words_of(t or ""), b""] for t in texts])[2].sum()
    assert sum(len(r["ids"]) for r in spans) == whole


def test_word_table_is_never_empty(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    for sizes in ([20_000] * 9, [30_000, *[20_000] * 9, 3], [50_000, 40_000, 20_001, 20_000, 20_000, 7, 7, 7], [4, 4], [10**12, 1, 1, 1, 1, 1, 1]):
        counts = spark.createDataFrame([(b"w%d" % k, c) for k, c in enumerate(sizes)], "word binary, c long")
        top, others = (df.collect() for df in lm.frequent_words(counts, max(sizes)))
        assert 0 < len(top) <= 5 and len(top) + len(others) == len(sizes) and not {bytes(r["word"]) for r in top} & {bytes(r["word"]) for r in others}
        assert min(r["c"] for r in top) >= max((r["c"] for r in others), default=0)


def test_scores_do_not_depend_on_the_word_table(spark, monkeypatch):
    # 40 words of equal counts above 10,000: more than the table holds
    docs = spark.createDataFrame([(k, " ".join(["government"] * 8 + [f"internal{j % 40}" for j in range(400)]) * 3) for k in range(500)], "doc_id long, text string")
    got = []
    for bound in (200_000, 20):
        monkeypatch.setattr(lm, "FREQUENT", bound)
        got.append({r["doc_id"]: r for r in lm.score_texts(docs, model_path()).collect()})
    for d, r in got[0].items():
        assert got[1][d]["n_known"] == r["n_known"] and abs(got[1][d]["base_score"] - r["base_score"]) < 1e-6
        assert abs(got[1][d]["score"] - r["score"]) < 0.05 * abs(r["score"]) + 1
