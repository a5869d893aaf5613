"""A corpus pipeline of five operators. Each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import mixing
from lamella.llm.common import DOCUMENT_COLUMNS, materialise, only, read_table, without
from lamella.llm.ngram_join import jaccard_groups
from lamella.llm.packing import pack
from lamella.llm.quality import keep_good
from lamella.llm.secret_scan import redact

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(df: DataFrame) -> DataFrame:
    return only(df, *DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones (score 0.3 or more), trained on the labels beside them.

    Repeated rows have equal scores, so they stay or go together. A null or empty text has the score of no tokens; a null id
    has no label and is scored. Without labels all scores are 0.5 and all rows stay. Other columns are not read; an empty table stays empty.
    """
    return keep_good(_documents(docs), read_table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles, the one of the smallest id; documents without words stay. Rows of one id and unlike texts are
    documents of their own, rows equal in id and text are one, and a null id comes after all others."""
    docs = _documents(docs)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        # ids don't tell the rows apart: numbers in the order of the ids do
        once = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
        ordered = once.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        docs = materialise(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn("row", F.col("doc_id").cast("long"))
    groups = materialise(jaccard_groups(docs.select(F.col("row").alias("doc_id"), "text"), 5, 75), "groups")
    out = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("row"))
    return without(docs, out, "row").select(*DOCUMENT_COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark.

    Null and empty texts stay as they are; a null source is an empty path; repeated rows are changed alike; an empty table stays empty.
    """
    return redact(_documents(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources have shares by the root of their size; in global random order.

    A null source is one of its own. Sources without characters (null and empty texts only) carry nothing to a mix, and their rows go.
    Rows equal in id and text have equal draws. An empty table stays empty.
    """
    return mixing.replicate(_documents(docs)).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens.

    A null or empty text is one token; longer texts than a sequence are cut; repeated rows are pieces of their own, and so are those of a
    null id. An empty table gives no row.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, _Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", packing),
]

#: Training and tokenising can't be written in SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again.

    Rows are documents, whatever their ids: repeated ones fall to the near-duplicate stage, ties between equal ones go to the smallest id, nulls
    are handled as each stage says. Columns beyond those of documents are dropped at the first stage. An empty table gives no row.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
