"""A corpus pipeline: quality, line dedup, near dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents, whatever they are called besides the five of the table. Between stages rows are written as Parquet
in the shared folder and read back. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, linededup, mixing, quality, simhash
from quillgrid.llm.common import fresh, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go.

    Null and empty texts are scored like others; repeated rows stay or go together.
    """
    model, names = quality.train(docs, table(spark, sf_dir, "labels")), fresh(docs.columns, "score", "predicted")
    scored = quality.score(docs, model, with_text=True, names=(names[0], names[1]))
    return scored.where(F.col(names[1]) == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that are boilerplate of their source go; n_chars follows the text.

    No document goes: a null text stays null, with a null size, and a text may end up empty. A null source is one source.
    """
    kept = linededup.drop_boilerplate(docs, "source")
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", size).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates stays, that of least id (null ids come last).

    Near duplicates share four fifths of their five-word shingles and differ by at most 5 bits in the fingerprints of
    their distinct words. Texts without words are one group; repeated rows are copies.
    """
    return simhash.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the mix takes them, in its order, the last of a source cut where its target ends.

    Documents without words are in no mix.
    """
    mixed = mixing.taken_rows(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return mixed.withColumn("n_chars", size).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids; repeated rows stay, and a text without words would have none."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("linededup", drop_lines),
    ("simhash", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm holds the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
