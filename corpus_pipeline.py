"""From raw documents to tokens: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages with Python tasks bound the session's Arrow batches (``small_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.bpe import encode_decode
from freshet.llm.common import doc_key
from freshet.llm.decontaminate import find_contamination
from freshet.llm.exact_dedup import exact_groups
from freshet.llm.near_dedup import near_groups
from freshet.llm.quality import REJECT_BELOW, fit_quality, score_quality
from freshet.llm.queries import table, tokenizer_path
from freshet.session import scratch_dir, settled, small_batches

# per cent; op2 has a threshold of its own
SIMILARITY = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. A null or empty text is rejected."""
    small_batches(spark)
    scored = score_quality(docs, fit_quality(docs), score="_quality_score")
    return scored.where(F.col("_quality_score") >= REJECT_BELOW).drop("_quality_score")


def _only(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps by their key of identifier and text; with ``once``, one row of every key.

    Of rows that repeat a key the least stays, by their columns from left to right.
    """
    keys = decided.groupBy("k", "t").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept")
    keys = settled(keys.select(F.col("k").alias("_kept_k"), F.col("t").alias("_kept_t"), "n"), "kept-keys")

    def rows(of: DataFrame) -> DataFrame:
        k, t = doc_key("doc_id", "text")
        return docs.join(of, (k == of["_kept_k"]) & (t == of["_kept_t"]), "left_semi")

    if not once:
        return rows(keys.drop("n"))
    repeated = keys.where("n > 1").drop("n")
    if repeated.isEmpty():
        return rows(keys.drop("n"))
    least = rows(repeated).groupBy(*doc_key("doc_id", "text")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return rows(keys.where("n = 1").drop("n")).unionByName(least.select("_row.*"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts."""
    return _only(docs, exact_groups(docs.select("doc_id", "text"), with_key=True), once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates, linked from a similarity of 0.80 on: the one with the smallest identifier."""
    small_batches(spark)
    return _only(docs, near_groups(docs.select("doc_id", "text"), similarity=SIMILARITY, with_key=True), once=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    small_batches(spark)
    found = find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_key=True)
    return _only(docs, found.select("k", "t", (F.col("n_hit") == 0).alias("kept")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of the text that they decode to."""
    small_batches(spark)
    return encode_decode(docs, tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

# The classifier is trained, so SQL cannot say which documents it keeps; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
