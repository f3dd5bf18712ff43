"""A corpus pipeline over ``documents``: toxicity, near copies, benchmark passages, personal data, token ids.

Each stage reads what its predecessor kept. ``run`` writes every stage to the session's shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions.keyfilter import key_filter
from outturn.llm import jaccard, pieces, private, suffixes, toxicity
from outturn.llm.common import staged, table, text_key, without_texts
from outturn.llm.queries import model_path, sha256


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject; decided by text, so ids may be null or occur twice. A null text stays."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


#: Near copies share four fifths of their five-word shingles; the query op8_jaccard_join has a rule of its own.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, an id that is null coming last.

    A row whose id is null or occurs again goes by a negative number made of its text's 64-bit hash, so that rows of one id with
    different texts are told apart. Rows without words are near copies of nothing and all stay; of rows that repeat id and text one
    stays.
    """
    key = text_key()
    twice = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice")), "twice")
    own = F.col("doc_id").isNotNull() & F.col("_twice").isNull()
    mark = F.when(own, F.col("doc_id")).otherwise(-2 - key.bitwiseAND(F.lit(2**62 - 1)))
    marked = docs.join(twice, F.col("doc_id") == F.col("_twice"), "left").select("doc_id", key.alias("key"), mark.alias("mark"), "text")
    groups = staged(
        jaccard.near_copies(marked.select(F.col("mark").alias("doc_id"), "text"), percent=NEAR_PERCENT, n=NEAR_WORDS)
        .where("n_shingles > 0").select(F.col("doc_id").alias("mark"), "component_id"),
        "near-groups",
    )
    rows = marked.groupBy("doc_id", "key", "mark").agg(F.count("*").alias("n")).join(groups, "mark")
    rows = staged(rows, "near-rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = rows.groupBy("component_id").agg(F.min(place).alias("first"))
    member = rows.join(first, "component_id").withColumn("stays", place == F.col("first"))
    gone, again = (
        staged(member.where(which).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "near-copies")
        for which in ("not stays", "stays and n > 1")
    )
    of_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key"))
    # rows that a filter of the copies' keys doesn't let through stay where they are, so that few texts are shuffled
    may = key_filter(gone, ["_id", "_key"])("doc_id", key)
    kept = docs.where(~may).union(docs.where(may).join(gone, of_row, "left_anti"))
    if again.isEmpty():
        return kept
    return kept.join(again, of_row, "left_anti").union(kept.join(again, of_row, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; decided by text, so ids may be null or occur twice. A null text stays."""
    found = suffixes.find_matches(docs.select(text_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = staged(found.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return without_texts(docs, bad)


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a null text stays null or empty, and every row is kept."""
    return private.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number and a hash of what they decode to; a null text counts as empty, rows that repeat are encoded each."""
    ids = pieces.decode(pieces.encode(docs, model_path()), model_path())
    return ids.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", sha256(F.col("text")).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_private),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The learnt stages can't be said in SQL; tests hold the pipeline against its brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the session's shared folder and read again; without documents there are no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
