"""A corpus in five stages; each is written as Parquet and read again as the next one's documents.

All stages keep their input's columns, whatever their names, and the last one adds two. Null and
empty texts are texts without words, a null doc_id is an ordinary one, and an empty table stays
empty; what else is defined for odd rows stands at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from tidemark.llm.common import table
from tidemark.sources.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network trained on the labels scores below the threshold (operator 9).

    Texts without words get the score of an empty window; rows that repeat a text stay or go together; without
    labels of both classes all documents stay. Every window of a long text counts.
    """
    lean(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space (operator 4).

    The one with most code points stays, then the least doc_id, a null one last; null and empty texts are equal,
    and so one of all of them stays; of rows that repeat doc_id and text one stays.
    """
    return exact_dedup.keep_unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts similar in five-word shingles, 0.8 or more (operator 2).

    The least doc_id of a group stays, a null one last; texts without words are one group; rows that repeat doc_id
    and text stay or go together.
    """
    lean(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item (operator 6).

    Texts without words stay; items without words have no windows; rows that repeat a text stay or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces, and the text decoded from these (operator 8).

    Null and empty texts have no ids and decode to the empty text. Columns that already have the new names stay, and
    the new ones get longer names.
    """
    lean(spark)
    return pieces.encode_rows(docs, pieces.Vocabulary.load(pieces.MODEL), decoded="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: No SQL: the first, third and last stage can't be expressed in it.
ORACLE_SQL: str | None = None


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Batches of a thousand rows to Python: an executor holds few texts twice. A stage's caller writes its result, so that only ``run`` can put the session's setting back."""
    spark.conf.set(BATCH, "1000")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
