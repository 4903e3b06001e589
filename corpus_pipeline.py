"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them in turn, each
stage's rows written as Parquet in the session's shared folder and read again as the next one's docs.
All stages but the last return the columns of documents.

Defined results: each stage works on whatever rows it is given and passes null and empty texts on, save
that a stage's own decision may reject them; an empty table stays empty through all stages. Columns other than those of
documents are left aside by every stage, so a clash of their names does no harm. Very long texts are judged, cut and packed whole. Repeated rows
count as often as they stand, until the join keeps one row of each id and text; a tie between documents goes to the smaller id. Rows
without an id pass the join. n_chars is counted anew where a stage changes a text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bloom, jaccard, packing, quality, secrets, suffixdedup
from lexiloom.storage import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars of the present text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a tail probability of the best grade under a half go.

    It is fitted on the labelled documents that reach the stage.
    """
    docs = docs.select(*COLUMNS)
    return quality.kept_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component of near copies the document with the smallest id stays.

    Near copies share words of five with a similarity of 0.8 or more. Of rows that repeat the id that
    stays, one of each text stays. Rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    told = jaccard.similar_classes(docs, n=5, percent=80)
    gone = told.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = told.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # only texts of ids that go or repeat are shuffled; the others pass as they are read
    either = bloom.marked(docs, "doc_id", bloom.bloom(gone.unionByName(repeated)))
    left = either.where("_passes").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return either.where("not _passes").unionByName(left.select(either.columns)).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of passages that stand in an earlier document too go."""
    return _counted(suffixdedup.deduplicated(docs.select(*COLUMNS)))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark."""
    return _counted(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing along the Hilbert curve into sequences of 2048 tokens: a row for each piece."""
    return packing.piece_digests(
        packing.pack(
            docs.select(*COLUMNS),
            public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"),
            public_tokenizers.PATTERN,
        )
    )


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("secret scans", redact),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as put:
        for name, stage in STAGES:
            before, docs = docs, put(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
            put.drop(before)
        return put.keep(docs)
