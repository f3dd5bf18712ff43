"""Operator 2: personal data by weak supervision.

Patterns find candidate spans: those of the base patterns, and looser ones of the same kinds (an address written out with
"at" and "dot" or in brackets, an ip with bracketed dots or in eight groups, a card of 13 to 15 digits, a telephone number
without a plus) and secrets. Labelers vote on each: the strict pattern, its form, gazetteers of known prefixes and endings, the
words around it, and its shape. Votes of all documents are counted by pattern; expectation-maximisation estimates how
reliable each labeler is for each kind, and a logistic span classifier is trained on the posteriors, over features
that the labelers don't see. Base spans always stay; the classifier decides about all others. A looser candidate of a base kind
that no labeler votes for, or whose words before it speak against it, is never added.

The counts have at most one row for each kind, vote pattern and feature pattern (a few thousand), whatever the input.

Results of corner cases: a null text counts as empty and has no spans; repeated rows are searched each; long runs of one character
take linear time; a null id stays; without any base span the looser candidates are judged by the other labelers.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, fit_logistic, lists, map_texts, sigmoid, staged, texts_of

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = 4

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}+")
DIGITS = re.compile(r"[0-9]")
#: Looser forms. What lies before "at" is read backwards from it, so that no run of letters is tried twice.
AT = re.compile(r" ?[(\[] ?(?:at|AT) ?[)\]] ?| (?:at|AT) ")
AT_ENDS = (" at ", "at)", "at]", "at )", "at ]", " AT ", "AT)", "AT]", "AT )", "AT ]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[(\[] ?(?:dot|DOT) ?[)\]] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)+")
IP_BRACKETS = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])")
IP_GROUPS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])")
NUMBER = re.compile(r"(?<![0-9A-Za-z+.$%#/-])\(?[0-9][ ().0-9-]*+")
THOUSANDS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,3}(?: [0-9]{3})+")

# Gazetteers of known beginnings and endings, and words that speak for or against a kind.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
PRIVATE_NETS = ("10.", "192.168.", "127.", "0.", "255.")
SPEAKS_FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax"), "secret": ("key", "token", "password", "passwd", "pwd", "secret", "auth", "api"),
}
SPEAKS_AGAINST = ("version", "isbn", "issn", "order", "invoice", "commit", "sha", "md5", "build", "figure", "http", "www")
WORD = re.compile(r"[A-Za-z]+")
BEFORE = 32


def _email(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the address ends at a domain and its local part runs back to the last match."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def _ip_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(values)) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the four base kinds, by start."""
    email = _email(text) if "@" in text else []
    ip, card, phone = [], [], []
    if DIGITS.search(text):
        ip = [m.span() for m in IP.finditer(text) if all(map(_ip_ok, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    card.append(m.span())
        if "+" in text:
            phone = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m.group())) <= 15]
    return [email, ip, card, phone]


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that overlap none of ``taken``; both are by start."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def _written_out(text: str) -> list[tuple[int, int]]:
    """Addresses with "at" or "dot" written out or in brackets."""
    out, end = [], 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        if host is None or m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, host.end()))
            end = host.end()
    return out


def loose_spans(text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Looser candidates of the base kinds, then secrets, by start; none overlaps a base span or a looser one of an earlier kind."""
    taken = sorted(s for spans in base for s in spans)
    digits = DIGITS.search(text) is not None
    email = _written_out(text) if any(e in text for e in AT_ENDS) else []
    ip, card, phone, secret = [], [], [], []
    if digits:
        if ".]" in text or ".)" in text:
            ip = [m.span() for m in IP_BRACKETS.finditer(text) if all(int(d) <= 255 for d in re.findall("[0-9]+", m.group()))]
        if ":" in text:
            ip = sorted(ip + [m.span() for m in IP_GROUPS.finditer(text)])
        for m in CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "") if 13 <= m.end() - m.start() <= 29 else ""
            if 13 <= len(number) <= 15 and luhn(number) and number.strip(number[0]):
                card.append(m.span())
        for m in NUMBER.finditer(text):
            body = m.group().rstrip(" ().-")
            end = m.start() + len(body)
            after = text[end : end + 1]
            if 11 <= len(body) <= 20 and 9 <= len(DIGITS.findall(body)) <= 11 and not (body.isdigit() or after.isalnum() or after in ("%", "/")):
                if not THOUSANDS.fullmatch(body):
                    phone.append((m.start(), end))
        secret = [m.span() for m in SECRET.finditer(text) if any(c.isalpha() for c in m.group())]
    secret = _free(secret, taken)
    out = []
    for spans in (email, ip, card, phone):
        out.append(_free(spans, taken))
        taken = sorted(taken + out[-1])
    # a secret keeps its place; a looser candidate inside one is given up
    return [*(_free(spans, secret) for spans in out), secret]


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidate spans, by kind, then start."""
    base = base_spans(text)
    loose = loose_spans(text, base)
    spans = [(k, a, b, True) for k, own in enumerate(base) for a, b in own] + [(k, a, b, False) for k, own in enumerate(loose) for a, b in own]
    return sorted(spans)


def _entropy(body: str) -> float:
    n = len(body)
    return -sum(c / n * math.log2(c / n) for c in (body.count(x) for x in set(body)))


def votes(kind: str, body: str, before: str, base: bool) -> tuple[int, ...]:
    """Of each labeler -1, 0 (abstains) or 1: strict pattern (never against), form, gazetteer, context, shape."""
    return (1 if base else 0, *_looks(kind, body, before, base))


def _looks(kind: str, body: str, before: str, base: bool) -> tuple[int, int, int, int]:
    lower = [w.lower() for w in WORD.findall(before)][-3:]
    near = any(w.endswith(SPEAKS_FOR[kind]) or w in SPEAKS_FOR[kind] for w in lower)
    against = any(w in SPEAKS_AGAINST for w in lower)
    context = 1 if near else -1 if against else 0
    if not base and kind == "email":
        ends = [w.lower() for w in WORD.findall(body)][-1:]
        known = bool(ends) and ends[0] in DOMAIN_ENDS
        return (1 if "[" in body or "(" in body or " dot " in body.lower() else -1, 1 if known else -1, context, 1 if len(body) < 64 else -1)
    if not base and kind == "ip":
        return (1, 0, context, 1 if len(set(re.findall("[0-9A-Fa-f]+", body))) > 2 else -1)
    if not base and kind == "card":
        digits = re.sub("[^0-9]", "", body)
        shape = re.fullmatch(r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", body)
        return (1 if shape else 0, 1 if digits.startswith(("34", "37", "30", "36", "38")) else -1, context, -1 if len(set(digits)) < 4 else 0)
    if not base and kind == "phone":
        shape = re.fullmatch(r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ -][0-9 -]{5,9}", body)
        return (1 if shape else -1, 1 if body.startswith(("0", "1", "(")) else 0, context, -1 if ".." in body or "--" in body or "  " in body else 0)
    if kind == "email":
        end = body.rsplit(".", 1)[-1].lower()
        return (1 if end.isalpha() and 2 <= len(end) <= 6 else -1, 1 if end in DOMAIN_ENDS else 0, context, 1 if len(body) < 64 else -1)
    if kind == "ip":
        plain = all(p == "0" or not p.startswith("0") for p in body.split("."))
        return (1 if plain else -1, -1 if body.startswith(PRIVATE_NETS) else 0, context, -1 if all(len(p) == 1 for p in body.split(".")) else 1)
    if kind == "card":
        digits = re.sub("[^0-9]", "", body)
        return (1 if re.fullmatch(r"[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}", body) else 0, 1 if digits.startswith(CARD_STARTS) else -1, context, -1 if len(set(digits)) < 4 else 1)
    if kind == "phone":
        count = len(DIGITS.findall(body))
        return (1 if 10 <= count <= 13 else 0, 1 if body.startswith(("+1", "+3", "+4")) else 0, context, -1 if ".." in body or "--" in body else 1)
    spread = _entropy(body)
    hexed = re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", body) is not None
    form = 1 if hexed or re.fullmatch(r"[A-Z]{4}[A-Z0-9]{16}", body) else -1 if "-" in body or "_" in body else 0
    return (form, 1 if body.startswith(KEY_STARTS) else 0, context, 1 if spread >= 3 else -1)


def features(kind: str, body: str, before: str) -> tuple[int, ...]:
    """Small bounded numbers: length class, share of digits, case, sign before."""
    digits = sum(c.isdigit() for c in body) / len(body)
    last = before[-1:] or "\n"
    return (
        min(3, len(body) // 12), min(3, int(4 * digits)), (2 if body == body.upper() else 1 if body == body.lower() else 0),
        0 if last.isspace() else 1 if last in "=\"':(<" else 2,
    )


FEATURE_SIZES, VOTERS = (4, 4, 3, 3), 5


def _code(values: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    out = 0
    for v, s in zip(values, sizes, strict=True):
        out = out * s + v
    return out


def _decode(code: int, sizes: tuple[int, ...]) -> list[int]:
    out = []
    for s in reversed(sizes):
        out.append(code % s)
        code //= s
    return out[::-1]


def _accepts(kind: int, pattern: int) -> bool:
    """Whether a looser candidate can be added at all: some labeler votes for it, and its context doesn't speak against it."""
    vote = [v - 1 for v in _decode(pattern // math.prod(FEATURE_SIZES), (3,) * VOTERS)]
    return kind == BASE or (vote[3] >= 0 and max(vote[1:4]) > 0)


def pattern_of(kind: int, body: str, before: str, base: bool) -> int:
    """The code of a candidate's votes and features."""
    vote = _code(tuple(v + 1 for v in votes(KINDS[kind], body, before, base)), (3,) * VOTERS)
    return vote * math.prod(FEATURE_SIZES) + _code(features(KINDS[kind], body, before), FEATURE_SIZES)


SPANS = "kind array<int>, start array<int>, end array<int>, base array<boolean>, pattern array<int>"


def find_candidates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the candidate spans by kind and start, each with the code of its votes and features."""
    id_kind = documents.schema[id_column].dataType.simpleString()

    def make():
        def step(batch):
            counts, rows = [], []
            for text in texts_of(batch, text_column):
                found = candidates(text)
                rows += [(k, a, b, base, pattern_of(k, text[a:b], text[max(0, a - BEFORE) : a], base)) for k, a, b, base in found]
                counts.append(len(found))
            flat = np.array(rows, np.int32).reshape(-1, 5)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            columns = [
                lists(flat[:, k] if kind != pa.bool_() else flat[:, k].astype(bool), np.array(counts, np.int64), kind)
                for k, kind in enumerate(kinds)
            ]
            yield pa.RecordBatch.from_arrays([column_of(batch, id_column), *columns], ["doc_id", "kind", "start", "end", "base", "pattern"])

        return step

    return map_texts(documents, [id_column, text_column], make, f"doc_id {id_kind}, {SPANS}")


def reliabilities(vote: np.ndarray, count: np.ndarray, rounds: int = 50, silent: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "personal" for each vote pattern, and P(vote | class) of each labeler, by expectation-maximisation.

    That a labeler abstains is evidence as its votes are, except for those in ``silent``.
    """
    post = np.clip(0.5 + 0.2 * vote.sum(1), 0.05, 0.95)
    voters = vote.shape[1]
    counts = np.stack([np.where((vote[:, k] == 0) & (k in silent), 0, 1) for k in range(voters)])
    table = np.zeros((voters, 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * count, post * count])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for labeler in range(voters):
            for side in (0, 1):
                # votes for (or against) are taken to be likelier in their own class: a light prior keeps the classes named
                prior_votes = np.array([0.5, 1.0, 2.0] if side else [2.0, 1.0, 0.5])
                got = np.bincount(vote[:, labeler] + 1, weights=weight[side] * counts[labeler], minlength=3) + prior_votes
                table[labeler, side] = got / got.sum()
        logs = np.log(prior)[:, None] + np.stack(
            [sum(counts[k] * np.log(table[k, side, vote[:, k] + 1]) for k in range(voters)) for side in (0, 1)]
        )
        new = sigmoid(logs[1] - logs[0])
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post, table


def span_classifier(patterns: DataFrame) -> dict[tuple[int, int], float]:
    """Probability of each (kind, pattern) from the counts of all documents."""
    rows = patterns.groupBy("kind", "pattern").count().collect()
    every = math.prod(FEATURE_SIZES)
    out: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        own = [(r["pattern"], r["count"]) for r in rows if r["kind"] == kind]
        if not own:
            continue
        own.sort()
        count = np.array([c for _, c in own], float)
        # the strict pattern says nothing about secrets
        first = 0 if kind < BASE else 1
        vote = np.array([[v - 1 for v in _decode(p // every, (3,) * VOTERS)][first:] for p, _ in own])
        post, _ = reliabilities(vote, count, silent=() if first else (0,))
        hot = np.zeros((len(own), sum(FEATURE_SIZES) + 3 * vote.shape[1]))
        for i, (p, _) in enumerate(own):
            at = 0
            for value, size in zip(_decode(p % every, FEATURE_SIZES), FEATURE_SIZES, strict=True):
                hot[i, at + value] = 1
                at += size
            for value in vote[i]:
                hot[i, at + value + 1] = 1
                at += 3
        scale = count / count.sum() * min(count.sum(), 1e4)
        x, y = np.vstack([hot, hot]), np.r_[np.ones(len(own)), np.zeros(len(own))]
        beta = fit_logistic(x, y, np.r_[scale * post, scale * (1 - post)], l2=0.1)
        final = sigmoid(np.hstack([hot, np.ones((len(own), 1))]) @ beta)
        out.update({(kind, p): float(q) for (p, _), q in zip(own, final, strict=True)})
    return out


def _added(found: DataFrame, threshold: float) -> frozenset[tuple[int, int]]:
    """(kind, pattern) of the candidates that are added to the base spans; at most a few thousand."""
    patterns = found.select(F.explode(F.arrays_zip("kind", "pattern")).alias("s")).select("s.kind", "s.pattern")
    return frozenset(key for key, q in span_classifier(patterns).items() if q >= threshold and _accepts(*key))


def find_private(documents: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: spans array<struct<kind: string, start: int, end: int, base: boolean>>, by kind as in ``KINDS``, then start."""
    found = staged(find_candidates(documents, id_column, text_column), "spans")
    kept = sorted(k * 1_000_000 + p for k, p in _added(found, threshold))
    spans = F.arrays_zip("kind", "start", "end", "base", "pattern")
    wanted = F.filter(spans, lambda s: s["base"] | (s["kind"] * 1_000_000 + s["pattern"]).isin(kept) if kept else s["base"])
    names = F.array(*map(F.lit, KINDS))
    return found.select(
        "doc_id",
        F.transform(
            wanted, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
        ).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span replaced by its kind in brackets and n_chars counted anew; other columns stay.

    The text is searched again where it lies, so only the list of accepted patterns leaves the first pass.
    """
    kept = _added(staged(find_candidates(documents).select("kind", "pattern"), "spans"), 0.5)
    schema = documents.schema
    at = schema.fieldNames().index("text")

    def clean(text: str) -> str:
        spans = [
            (a, b, KINDS[k]) for k, a, b, base in candidates(text)
            if base or (k, pattern_of(k, text[a:b], text[max(0, a - BEFORE) : a], base)) in kept
        ]
        out, end = [], 0
        for a, b, kind in sorted(spans):
            if a >= end:
                out += [text[end:a], f"[{kind}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts = [None if t is None else clean(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = documents.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
