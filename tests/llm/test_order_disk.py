"""Training order: tables that it deletes, and words that are encoded once."""

import os

import sentencepiece

from outturn.llm import pieces
from outturn.llm.common import shared_folder
from outturn.llm.queries import QUERIES, model_path


def test_training_order_leaves_its_shards_alone(spark, sf_dir):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    QUERIES["op3_training_order"](spark, sf_dir)
    assert {name.partition("-")[0] for name in set(os.listdir(folder)) - before} == {"shards"}


def test_parts_of_words_are_merged_once():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path()), pieces.Encoder(model_path())
    texts = ["tianor, tianor; tianor?  tianor!", "", " (tianor) tianor's\ntianor\n\n ", "▁tianor " * 3, "日本tianor🦊tianor"]
    flat, counts = encoder.encode(texts)
    assert flat.tolist() == [i for t in texts for i in library.encode(t)]
    assert counts.tolist() == [len(library.encode(t)) for t in texts]
    assert sum("tianor" in part for part in encoder.of_parts.place) <= 3 < sum("tianor" in word for word in encoder.of_words.place)
