"""Operator 6: token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry failure links: when no edge continues a match, the link leads to the node of what
remains after the longest pieces are popped, and a precomputed count says how many were popped. A word is read
once, character by character, and the number of greedy longest-match pieces comes out without building any piece.

Results of corner cases: a null or empty text has 0 words and 0 tokens; a word that the vocabulary can't spell is one
token; repeated rows are counted each; a null id stays.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from outturn.llm.common import column_of, map_texts, texts_of
from outturn.llm.pieces import SPACE, vocabulary

WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]")
REMEMBERED = 200_000


class Automaton:
    def __init__(self, words: list[str]) -> None:
        """Children, failure links and popped counts over the trie of ``words``."""
        self.child: list[dict[str, int]] = [{}]
        final = {0: False}
        for word in words:
            node = 0
            for char in word:
                step = self.child[node].get(char)
                if step is None:
                    step = len(self.child)
                    self.child[node][char] = step
                    self.child.append({})
                node = step
            final[node] = True
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for char, below in self.child[node].items():
                queue.append(below)
                if final.get(below):
                    self.link[below], self.popped[below] = 0, 1
                    continue
                back, count = self.link[node], self.popped[node]
                while back >= 0 and char not in self.child[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[below], self.popped[below] = self.child[back][char], count

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of ``word``; 1 where they can't spell it."""
        node = total = 0
        for char in word:
            while char not in self.child[node]:
                if self.link[node] < 0:
                    return 1
                total += self.popped[node]
                node = self.link[node]
            node = self.child[node][char]
        while node:
            if self.link[node] < 0:
                return 1
            total += self.popped[node]
            node = self.link[node]
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Over the normal pieces of a model file; the space mark in front of a word marks its start."""
    return Automaton([p for p in vocabulary(path).ids if SPACE not in p[1:]])


def token_counts(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, n_words and n_tokens of the whole text."""
    kind = df.schema[id_column].dataType.simpleString()

    def make():
        machine = automaton(model_path)
        known: dict[str, int] = {}

        def step(batch):
            words, tokens = [], []
            for text in texts_of(batch, text_column):
                found = WORD.findall(text)
                for word in set(found):
                    if word not in known:
                        known[word] = machine.count(SPACE + word)
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, id_column), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                ["doc_id", "n_words", "n_tokens"],
            )

        return step

    return map_texts(df, [id_column, text_column], make, f"doc_id {kind}, n_words bigint, n_tokens bigint")
