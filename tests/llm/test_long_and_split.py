"""Long words take time in proportion, and what a model learns does not follow from how the input is split."""

import random
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from outturn.llm import lm, order, pieces
from outturn.llm.buckets import bucket_of
from outturn.llm.common import table
from outturn.llm.queries import model_path


def test_long_words_equal_the_library():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path()), pieces.Encoder(model_path())
    draw = random.Random(8)
    texts = [" " * n for n in (255, 256, 257, 1000, 4097)] + ["a" * 3001, "ab" * 2000, "0" * 999, "漢" * 700 + " é" * 400, "x " * 300 + " " * 600 + "y"]
    texts += ["".join(draw.choices(letters, k=draw.randint(200, 900))) for letters in ("ab", "aeinrst", " a", "=-", "0123456789", "aé漢😀 ") for _ in range(40)]
    flat, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == library.encode(text)
        at += n


@pytest.mark.parametrize("kind", ["spaces", "letters", "digits", "same"])
def test_a_million_characters_without_a_break(kind):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path()), pieces.Encoder(model_path())
    letters = {"spaces": " ", "letters": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789", "same": "e"}[kind]
    text = "".join(random.Random(9).choices(letters, k=1_000_000))
    start = time.process_time()
    flat, _ = encoder.encode([text])
    assert time.process_time() - start < 30
    assert flat.tolist() == library.encode(text)


def test_scores_do_not_depend_on_the_split(spark):
    docs, sums = table(spark, "/root/testdata/sf0.01", "documents"), []
    for parts in (1, 8, 64):
        scored = lm.score_texts(docs.repartition(parts), model_path())
        sums.append(scored.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.min("score")).first())
    for found in sums:
        assert found[0] > found[1]
        assert list(found) == pytest.approx(list(sums[0]), rel=1e-5)


def test_many_groups_still_beat_word_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 128)
    scored = lm.score_texts(table(spark, "/root/testdata/sf0.01", "documents"), model_path())
    found = scored.agg(F.sum(F.when(F.col("held_out"), F.col("score"))), F.sum(F.when(F.col("held_out"), F.col("base_score")))).first()
    assert found[0] > 1.03 * found[1]


def test_an_id_with_half_of_all_rows_is_split(spark, tmp_path):
    docs = [(5 if k % 2 else k, [k + 10] * (k % 7)) for k in range(2000)] + [(None, [1])]
    packed = order.packed(spark.createDataFrame(docs, "doc_id long, ids array<int>"), order.Ids(2, 1, 65535))
    rows, total = order.numbered(packed, 8)
    units = rows.groupBy("unit").count().collect()
    assert max(u["count"] for u in units) <= 400 and total == sum(k % 7 // 4 + 1 for k in range(2000))
    path = str(tmp_path / "shards")
    kind = order.Ids(2, 1, 65535)
    assert order.write_shards(spark.createDataFrame(docs, "doc_id long, ids array<int>"), path, 11, 4, 64, kind) == total
    found = order.read_records(spark, path, 0, 4, 64, kind).collect()
    assert sorted(r["slot"] for r in found) == list(range(total))
    of_hot = sorted((r["seq_no"], bytes(r["ids"])) for r in found if r["doc_id"] == 5)
    assert [n for n, _ in of_hot] == list(range(len(of_hot)))
    ids = np.concatenate([kind.unpack(body) for _, body in of_hot])
    ids = "".join(chr(i) for i in ids if i != kind.pad).split("\x01")[:-1]
    assert sorted(ids) == sorted("".join(map(chr, d[1])) for d in docs if d[0] == 5)


def test_bucket_is_the_number_of_bounds_reached(spark):
    rows = spark.range(-3, 60).toDF("doc_id")
    for bounds in ([], [0], [4, 9], list(range(1, 50, 3))):
        found = rows.select("doc_id", bucket_of(bounds).alias("b")).collect()
        assert all(r["b"] == sum(x <= r["doc_id"] for x in bounds) for r in found)
