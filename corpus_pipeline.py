"""A corpus pipeline of five text operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes each stage's rows as Parquet into the session's shared
checkpoint folder and reads them again. The first four return the columns of
``documents``: toxic documents go, one document of each group of near-duplicates
stays, documents that hold a benchmark passage go, personal data is replaced by
its kind. The last returns the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavepanel.llm import bpe, decontaminate, pii, simhash, toxicity
from wavepanel.llm.common import read_table, write_shared
from wavepanel.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents' labels, scores below 0.5.
    Null and empty texts stay, repeated rows stay or go together, extra columns are kept; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (3-word shingles, 3 bits).
    Null and empty texts are one group, repeated rows become one, rows without id give way to others; an empty table stays empty."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked.
    Null and empty texts and rows without id stay, repeated rows stay or go together; an empty table stays empty."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind.
    Null and empty texts stay as they are, repeated rows are each kept; an empty table stays empty."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, their digest, that of the decoded text, and the ids (u32 little-endian).
    Null texts count as empty and have no tokens, repeated rows are each returned; an empty table gives no rows."""
    return bpe.bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), with_ids=True, keep=["lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_pii),
    ("bpe encoding and decoding", tokens),
]

#: SQL expresses neither the trained model nor the token ids; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
