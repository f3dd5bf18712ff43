"""Queries of this package over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.llm import (
    fingerprints, forest, jaccard, lm, order, pieces, prefixes, private, quality, runs, suffixes, toxicity, wordpiece,
)
from outturn.llm.common import table


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = private.KINDS[: private.BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base), sha256(joined(F.filter("spans", lambda s: s["base"]))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = order.tokenised(table(spark, sf_dir, "documents"), model_path())
    return order.materialise(ids, kind=order.ids_of(model_path()), own=True)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encode(table(spark, sf_dir, "documents"), model_path())
    return pieces.decode(ids, model_path()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("text")).alias("decoded_sha256"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), model_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), model_path())


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents"), reorder=runs.recurring)
    top = F.col("strongest")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(top[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        sha256(F.array_join(line, "")).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = forest.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefixes.sequences(table(spark, sf_dir, "conversations"))
    return prefixes.prefix_trie(prefixes.with_shared_openings(own))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_private": op2_private,
    "op3_training_order": op3_training_order,
    "op4_pieces": op4_pieces,
    "op5_fingerprints": op5_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_runs": op11_runs,
    "op12_forest": op12_forest,
    "op13_prefixes": op13_prefixes,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS v
            FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM s)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS v
           FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, k, item_id FROM places JOIN windows USING (n, v)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hits))
          GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def _components_sql(words: int, percent: int, kept: str = "") -> str:
    """Components of the exact join of all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id,
        CASE WHEN len(w) < {words} THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + {words - 1}], ' ') END AS v
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {words - 1}))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.v = y.v AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id{kept}
FROM d JOIN reach r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""


_OP8 = _components_sql(3, 90)
_OP12 = _components_sql(5, 85, ", d.doc_id = min(other) AS kept")

#: The first steps compute crc32 of the decimal id: a byte, then eight shifts with the polynomial where the lowest bit is set.
_OP13 = r"""
WITH RECURSIVE crc(conv_id, byte, bit, c) AS (
  SELECT DISTINCT conv_id, 0, 8, 4294967295::UBIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, CASE WHEN bit = 8 THEN byte + 1 ELSE byte END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
         CASE WHEN bit = 8 THEN xor(c, ascii(substr(CAST(conv_id AS VARCHAR), byte + 1, 1))::UBIGINT)
              ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END
  FROM crc WHERE byte < length(CAST(conv_id AS VARCHAR)) OR bit < 8),
marks AS (SELECT conv_id, CAST(xor(c, 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM crc
          WHERE byte = length(CAST(conv_id AS VARCHAR)) AND bit = 8),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                 md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
built AS (SELECT m.conv_id, o.k, o.role, o.text FROM marks m JOIN own o ON o.conv_id = m.conv_id - m.conv_id % 20 AND o.k <= m.h
          UNION ALL SELECT m.conv_id, o.k, o.role, o.text FROM marks m JOIN own o USING (conv_id) WHERE o.k > m.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, role, text FROM built),
paths AS (SELECT m.conv_id, coalesce(list({'role': t.role, 'text': t.text} ORDER BY t.d) FILTER (t.d IS NOT NULL), []) AS p
          FROM marks m LEFT JOIN turns t USING (conv_id) GROUP BY m.conv_id),
members AS (SELECT conv_id, len(p) AS n, d, md5(CAST(p[1:d] AS VARCHAR) || '/' || d) AS node,
                   CASE WHEN d > 0 THEN md5(CAST(p[1:d - 1] AS VARCHAR) || '/' || (d - 1)) END AS parent,
                   CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].text, '[^ 	-
]+')) ELSE 0 END AS words
            FROM (SELECT conv_id, p, unnest(generate_series(0, len(p))) AS d FROM paths)),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 any_value(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends
          FROM members GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above(node, up) AS (SELECT node, node FROM nodes
                    UNION ALL SELECT a.node, n.parent FROM above a JOIN nodes n ON a.up = n.node WHERE n.parent IS NOT NULL),
sums AS (SELECT a.up AS node, sum((n.n_convs - 1) * n.words) AS saved_tokens,
                count(*) FILTER (k.n_children IS NULL) AS n_leaves
         FROM above a JOIN nodes n USING (node) LEFT JOIN kids k USING (node) GROUP BY a.up)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
"""


def oracles() -> dict[str, str]:
    return {"op7_decontamination": _OP7, "op8_jaccard_join": _OP8, "op12_forest": _OP12, "op13_prefixes": _OP13}
