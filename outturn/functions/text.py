"""Text helpers on Columns: whitespace, match positions, most repeated value, money.

All of them work inside the row that holds the text, so documents are never
shuffled to be read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P


def read_once(df: DataFrame, kept: list[str], found: dict[str, Column]) -> DataFrame:
    """``kept`` plus the ``found`` columns, each computed exactly once per row.

    A filter on a column found in text would otherwise be pushed below this step with the
    whole expression copied into it, once per mention. A generated row stops that. The row is made by the step before, as Spark
    compiles projections but interprets what stands in a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in found.items()])
    # an array made here has one element for certain, so no filter on its size is inferred and pushed down
    return df.select(*kept, row.alias("_row")).select(*kept, F.inline(F.array("_row")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flatten(text: Column) -> Column:
    return F.regexp_replace(text, P.UNTIDY_SPACE, " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACE_TEXT))


def fold(text: Column) -> Column:
    """Lower case, and ASCII for the few other letters that a pattern ignoring case takes for one."""
    odd = reduce(Column.__or__, [text.contains(c) for c in P.FOLDED])
    return F.lower(F.when(odd, F.translate(text, P.FOLDED, P.FOLDED_TO)).otherwise(text))


#: Letters of running text, from rare to frequent.
_BY_FREQUENCY = "jqzxkvbwygpfmucdlhrsnioate "


def has_word(lowered: Column, word: str) -> Column:
    """``contains``, after the same test for an end of the word that begins with a rare letter.

    The search compares wherever the first letter occurs, so that a word with a frequent one costs many times as much.
    """
    end = min((word[i:] for i in range(max(len(word) - 3, 1))), key=lambda e: (_BY_FREQUENCY.find(e[0]), -len(e)))
    return lowered.contains(word) if end == word else lowered.contains(end) & lowered.contains(word)


def may_match(lowered: Column, pattern: str) -> Column:
    """A cheap test that is true wherever the pattern matches; ``lowered`` is the folded text."""
    words = [has_word(lowered, w) for w in P.NEEDED_WORDS[pattern]]
    return reduce(Column.__or__, words)


def first_place(lowered: Column, pattern: str) -> Column:
    """Characters before the first place where a match can begin; null where there is no needed word. Counted in a flat text."""
    found = [F.when(has_word(lowered, w), F.position(F.lit(w), lowered)) for w in P.NEEDED_WORDS[pattern]]
    return F.greatest((found[0] if len(found) == 1 else F.least(*found)) - 1 - P.REACH[pattern][0], F.lit(0))


def near(flat: Column, lowered: Column, pattern: str, first: Column) -> Column:
    """The part of a flat text outside of which the pattern can't match, from its ``first_place`` on; null where that is null."""
    after = P.REACH[pattern][1]
    if after is None:
        return F.substr(flat, first + 1)
    rest = [F.length(F.substring_index(lowered, w, -1)) for w in P.NEEDED_WORDS[pattern]]
    # behind the last needed word; a word that is missing leaves the whole text behind it
    behind = rest[0] if len(rest) == 1 else F.least(*rest)
    return F.when(first.isNotNull(), F.substr(flat, first + 1, F.length(lowered) - behind + after - first))


def with_parts(df: DataFrame, flat: str, lowered: str, patterns: list[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """``df`` with the place and the text of the part near each pattern's words, and these columns by pattern.

    They are columns of a step of their own because functions over arrays interpret what is written inside them.
    """
    names = {p: (f"{flat}_from{i}", f"{flat}_part{i}") for i, p in enumerate(patterns)}
    df = df.withColumns({at: first_place(F.col(lowered), p) for p, (at, _) in names.items()})
    df = df.withColumns({part: near(F.col(flat), F.col(lowered), p, F.col(at)) for p, (at, part) in names.items()})
    return df, {p: (F.col(at), F.col(part)) for p, (at, part) in names.items()}


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The matched text, or null when there is none; the pattern runs once, which ``nullif`` in a branch doesn't grant."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda m: m != ""), F.lit(0))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


_MARK = "\ue000"  # private use: a text that has it takes the slower path


def pieces(text: Column, pattern: str) -> Column:
    """The text between matches, as ``split`` gives it.

    ``split`` compiles its pattern for every row; marking the matches first and splitting
    at the mark does not.
    """
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    return F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(marked)


def last_match_start(text: Column, pattern: str) -> Column:
    """Zero-based start of the last match, -1 when there is none."""

    def start(matches: Column) -> Column:
        tail = F.element_at(pieces(text, pattern), -1)
        at = F.length(text) - F.length(tail) - F.length(F.element_at(matches, -1))
        return F.when(F.size(matches) > 0, at).otherwise(-1)

    return let(all_matches(text, pattern), start)


def match_start(text: Column, pattern: str, index: Column, matches: Column) -> Column:
    """Zero-based start of the match with the given zero-based index."""
    gaps = F.array_join(F.slice(pieces(text, pattern), 1, index + 1), "")
    earlier = F.array_join(F.slice(matches, 1, index), "")
    return F.length(gaps) + F.length(earlier)


def most_repeated(values: Column) -> Column:
    """struct(value, at): the most frequent element and the index it first appears at.

    Ties go to whichever appeared first; null elements are ignored; null without any. One
    sort and one pass over run lengths, so a long document stays linear. A single element needs neither.
    """

    def single(v: Column) -> Column:
        only = F.get(v, F.lit(0))
        return F.when(only.isNotNull(), F.struct(only.alias("value"), F.lit(0).alias("at")))

    return let(values, lambda v: F.when(F.size(v) == 1, single(v)).when(F.size(v) > 1, _most_repeated(v)))


def _most_repeated(values: Column) -> Column:
    positioned = F.filter(
        F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("at"))),
        lambda e: e["value"].isNotNull(),
    )
    zero = F.struct(
        F.lit("").alias("value"), F.lit(-1).alias("at"), F.lit(0).alias("n"),
        F.lit("").alias("best"), F.lit(-1).alias("best_at"), F.lit(0).alias("best_n"),
    )

    def step(run: Column, e: Column) -> Column:
        same = (run["value"] == e["value"]) & (run["n"] > 0)
        n = F.when(same, run["n"] + 1).otherwise(1)
        at = F.when(same, run["at"]).otherwise(e["at"])
        better = (n > run["best_n"]) | ((n == run["best_n"]) & (at < run["best_at"]))
        return F.struct(
            e["value"].alias("value"), at.alias("at"), n.alias("n"),
            F.when(better, e["value"]).otherwise(run["best"]).alias("best"),
            F.when(better, at).otherwise(run["best_at"]).alias("best_at"),
            F.when(better, n).otherwise(run["best_n"]).alias("best_n"),
        )

    return F.aggregate(
        F.array_sort(positioned), zero, step,
        lambda run: F.when(
            run["best_n"] > 0, F.struct(run["best"].alias("value"), run["best_at"].alias("at"))
        ),
    )


def scale_factor(word: Column) -> Column:
    word = F.lower(word)
    return (
        F.when(word == "thousand", 1e3).when(word == "million", 1e6).when(word == "billion", 1e9)
        .otherwise(1.0)
    )


def amount(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def money(text: Column, pattern: str) -> Column:
    """First match of a pattern whose groups are the amount and its scale word."""

    def read(match: Column) -> Column:
        word = F.regexp_extract(match, pattern, 2)
        return amount(F.regexp_extract(match, pattern, 1)) * scale_factor(word)

    return let(first_match(text, pattern), read)
