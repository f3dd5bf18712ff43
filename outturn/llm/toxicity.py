"""Operator 9: toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to tags: insult, threat, target, negation and reported speech. Small transducers over those tags
are composed: one follows negation and its scope, one follows reported speech, one remembers whether the clause has a target. A matched
insult or threat carries its weight into the slot of the composed state that it is read in, at the end of its clause.
A text is scored by its matched clauses through weights per slot, not by isolated words.

Insults come from seeds and from labelled texts: whole words, and stems that may take any ending. A pattern counts as often as it stands
after different words, so copies of one text don't make a lexicon. Lexicon and slot weights are fitted on at
most ``LABELLED`` labelled rows, those of the smallest hashes; every other step covers all documents.

Results of corner cases: a null, empty or clean text gets the score of no match; without labelled rows of both
kinds the seeds score alone; repeated rows are scored each; a null id stays, and is never learnt from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, fit_logistic, lists, map_texts, remainder, sigmoid, staged, text_key, texts_of, without_texts
from outturn.llm.suffixes import words_of

#: Bound of the labelled rows from which lexicon and weights are fitted, and of the patterns learnt from them.
LABELLED, LEARNT = 8_000, 400
#: Lengths of the stems that are tried, and the least odds (at the lower end of their interval) of a pattern that is kept.
STEMS, LEAST_ODDS = range(3, 9), 3.0
#: Distinct words whose patterns a task remembers before it starts anew.
REMEMBERED = 100_000
#: Words that a negation reaches over.
SCOPE = 4

# Seed words of the grammar in English, German, French and Spanish.
INSULTS = "idiot idiots moron stupid scum trash loser losers pathetic worthless disgusting dumb trottel dummkopf abschaum idiota imbécil basura imbécile crétin ordure".split()
THREATS = "kill kills murder hurt destroy strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours you're u he she they them him her du dich dir ihr sie tu toi vous votre tú te usted ustedes".split()
NEGATIONS = "not no never isn't aren't don't doesn't won't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say told called calls wrote quoted reported sagte sagt nannte dit disait appelé dijo dice llamó".split()

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)
CLAUSE_END = re.compile(r"[.!?;:\n\r]+(?=\s|$)|[\n\r]+")
#: Slots: (insult or threat) x target x negated x reported.
SLOTS = 16


@dataclass
class Transducer:
    """States over tags; a missing edge stays. ``fade`` leads back to the start after so many words."""

    edges: dict[tuple[int, int], int]
    fade: int | None = None

    def step(self, state: int, tag: int) -> int:
        return self.edges.get((state, tag), state)


NEGATED = Transducer({(0, NEGATION): 1, (1, NEGATION): 0}, fade=SCOPE)
REPORTED = Transducer({(0, REPORT): 1})
TARGETED = Transducer({(0, TARGET): 1})


def patterns_of(word: bytes) -> list[str]:
    """The patterns that a word matches: itself, marked by its end, and its proper stems."""
    text = word.decode("utf-8", "replace")
    return [text + "$", *(text[:k] for k in STEMS if k < len(text))]


@dataclass
class Grammar:
    """Tags of whole words, and weights of the patterns of insults and threats; matching composes the three transducers."""

    tags: dict[bytes, int]
    weights: dict[str, float]
    known: dict[bytes, tuple[int, float] | None] = field(default_factory=dict)

    def read(self, word: bytes) -> tuple[int, float] | None:
        """Tag and weight of a word: that of its heaviest pattern."""
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            tag = self.tags.get(word)
            weight = max((self.weights[p] for p in patterns_of(word) if p in self.weights), default=None)
            self.known[word] = (THREAT if tag == THREAT else INSULT, weight) if weight is not None else None if tag is None else (tag, 0.0)
        return self.known[word]

    def strong(self, words: list[bytes]) -> bool:
        return any((found := self.read(w)) and found[0] in (INSULT, THREAT) for w in set(words))

    def clause(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(slot, weight) of each match in a clause."""
        negated = reported = targeted = age = 0
        matched = []
        for word in words:
            age += 1
            if negated and age > NEGATED.fade:
                negated = 0
            found = self.read(word)
            if found is None:
                continue
            tag, weight = found
            if tag == NEGATION:
                age = 0
            negated, reported, targeted = NEGATED.step(negated, tag), REPORTED.step(reported, tag), TARGETED.step(targeted, tag)
            if tag in (INSULT, THREAT):
                matched.append((tag, negated, reported, weight))
        # a target after the insult counts as well, so it is read at the end of the clause
        return [((tag * 2 + targeted) * 4 + n * 2 + r, w) for tag, n, r, w in matched]

    def features(self, text: str) -> np.ndarray:
        """Per slot the log of the matched weight, then the log of matched clauses and of the weight per 100 words."""
        out = np.zeros(SLOTS + 2)
        words = words_of(text)
        if not self.strong(words):
            return out
        for part in CLAUSE_END.split(text):
            clause = words_of(part)
            if not self.strong(clause):
                continue
            matched = self.clause(clause)
            out[SLOTS] += 1
            for slot, weight in matched:
                out[slot] += weight
        total = out[:SLOTS].sum()
        out[:SLOTS] = np.log1p(out[:SLOTS])
        out[SLOTS] = math.log1p(out[SLOTS])
        out[SLOTS + 1] = math.log1p(100 * total / len(words))
        return out


def seeds() -> tuple[dict[bytes, int], dict[str, float]]:
    tags: dict[bytes, int] = {}
    for tag, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
        for word in group:
            parts = words_of(word)
            if len(parts) == 1:
                tags[parts[0]] = tag
    return tags, {w.decode() + "$": 2.0 for w, tag in tags.items() if tag in (INSULT, THREAT)}


def sample_of(labels: DataFrame, column: str, modulus: int, out: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows (doc_id, label): the smallest hashes of those not held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).where(remainder(F.col("doc_id"), modulus) != out)
    picked = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _count_patterns(rows: DataFrame) -> DataFrame:
    """Documents of either label that hold a pattern, summed in each task first."""

    def flush(counts):
        both = list(counts.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in both], pa.int64()), pa.array([c[1] for c in both], pa.int64())],
            ["pattern", "clean", "toxic"],
        )

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pattern in {p for w in set(words_of(text or "")) for p in patterns_of(w)}:
                    counts.setdefault(pattern, [0, 0])[label] += 1
                if len(counts) > 100_000:
                    yield flush(counts)
                    counts = {}
        yield flush(counts)

    counted = rows.select("text", "label").mapInArrow(run, "pattern string, clean bigint, toxic bigint")
    return counted.groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _count_contexts(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """For each of the patterns, the number of different words that it stands after in toxic texts."""
    wanted = frozenset(patterns)

    def run(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                found = words_of(text or "")
                for i, word in enumerate(found):
                    seen |= {(p, found[i - 1] if i else b"") for p in patterns_of(word) if p in wanted}
            got = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in got], pa.string()), pa.array([r[1] for r in got], pa.binary())], ["pattern", "before"]
            )

    pairs = rows.where("label = 1").select("text").mapInArrow(run, "pattern string, before binary").distinct()
    return pairs.groupBy("pattern").agg(F.count("*").alias("contexts"))


def learn_grammar(texts: DataFrame) -> Grammar:
    """Lexicon from (text, label) rows of a bounded sample, on top of the seeds."""
    tags, weights = seeds()
    total = dict(texts.groupBy("label").count().collect())
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if clean and toxic:
        odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1) / ((F.col("clean") + 0.5) / F.lit(clean + 1)))
        least = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        first = (
            _count_patterns(texts).where(F.col("toxic") >= max(5, 0.01 * toxic))
            .select("pattern", odds.alias("odds"), least.alias("least"), (least * F.sqrt("toxic")).alias("rank"))
            .where(F.col("least") >= math.log(LEAST_ODDS)).orderBy(F.desc("rank"), F.desc(F.length("pattern")), "pattern").limit(10 * LEARNT).collect()
        )
        if first:
            contexts = dict(_count_contexts(texts, [r["pattern"] for r in first]).collect())
            chosen: list[str] = []
            for row in first:
                stem = row["pattern"].rstrip("$")
                # a word of copied passages has few contexts, a word in use has many
                if contexts.get(row["pattern"], 0) < max(8, 0.01 * toxic) or len(chosen) >= LEARNT:
                    continue
                if not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
                    chosen.append(stem)
                    weights[row["pattern"]] = min(5.0, row["odds"])
    return Grammar(tags, weights)


def match_features(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and the feature array of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch):
            rows = np.concatenate([grammar.features(t) for t in texts_of(batch)] or [np.zeros(0)])
            features = lists(rows, np.full(batch.num_rows, SLOTS + 2), pa.float64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), features], ["doc_id", "features"])

        return step

    return map_texts(documents, ["doc_id", "text"], make, f"doc_id {kind}, features array<double>")


def fit_toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2) -> tuple[Grammar, Column]:
    """The learnt grammar, and the score as a Column over its features."""
    documents = documents.select("doc_id", "text")
    sample = staged(sample_of(labels, "toxic", modulus, out, LABELLED), "toxic-sample")
    texts = staged(documents.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), "toxic-texts")
    grammar = learn_grammar(texts)
    rows = match_features(texts.select("doc_id", "text"), grammar).join(F.broadcast(sample), "doc_id").select("features", "label").toPandas()
    beta = np.r_[np.full(SLOTS + 1, 1.0), 1.0, -3.0]
    if len(rows) and rows["label"].nunique() == 2:
        beta = fit_logistic(np.stack(rows["features"].to_numpy()), rows["label"].to_numpy(float), l2=0.5)
    elif len(rows):
        beta[-1] = -3.0
    total = F.lit(float(beta[-1]))
    for k in range(SLOTS + 2):
        total = total + F.col("features")[k] * F.lit(float(beta[k]))
    return grammar, F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted."""
    grammar, score = fit_toxicity(documents, labels, modulus, out)
    found = match_features(documents, grammar).select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), score.alias("score")
    )
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``documents`` without those predicted toxic.

    A decision follows from the text and is met by the text's key, so rows with a null id go like others, and of rows with one id
    only the toxic ones go.
    """
    grammar, score = fit_toxicity(documents, labels)
    keyed = match_features(documents.select(text_key().alias("doc_id"), "text"), grammar)
    bad = staged(keyed.where(score >= threshold).select(F.col("doc_id").alias("key")).distinct(), "toxic")
    return without_texts(documents, bad)
