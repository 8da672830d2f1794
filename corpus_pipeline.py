"""The corpus pipeline: language, near copies, benchmark passages, secrets, tokens; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, decontaminate, langid, neardup, queries, secrets
from cellweave.llm.common import fold, materialise, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; rejected ones go.

    The model learns from the labelled rows of `docs` outside the held-out fold. Null texts and texts without letters go, as do ties between
    languages; without any labelled row every document goes. Repeated rows are judged alike. An empty table stays empty."""
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, model, COLUMNS).where("not rejected").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null ids last.

    Ids may be null or repeat: groups are told by texts. Of rows that repeat one stays; null, empty and wordless texts all stay. An empty
    table stays empty."""
    return neardup.representatives(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay. All rows of an id go if one of them leaks, repeated rows and a null id included. With no items, or none with words,
    all stay."""
    with small_batches(spark):
        found = materialise(decontaminate.leaks(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced by a mark; n_chars follows the text.

    Null texts stay null, with n_chars null. Overlapping spans become one mark. Repeated rows are changed alike. An empty table stays empty."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row a document.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows repeat theirs. An empty table gives no rows."""
    with small_batches(spark):
        return materialise(bpe.encode_documents(docs, queries.tokenizer_path(), ["doc_id", "lang", "source"]), "tokens")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("secret_spans", secret_spans), ("tokens", tokens)]
#: No stage but the fourth can be told in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
