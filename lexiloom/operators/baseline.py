"""A TF-IDF and logistic baseline: word 1-2 grams and character 3-5 grams, balanced classes.

Terms are 64-bit hashes from the start: tasks count them in arrays of numbers, one table sums documents and occurrences of each
term, and the vocabulary is the most frequent terms of enough documents, at most 60,000 numbers, which are part of the fitted stage. Each block
of a vector is (1 + ln count) * (ln((1 + n) / (1 + documents)) + 1), scaled to length 1. The intercept is the weight of a feature that is always
1, so it is penalised as the others are; MLlib minimises the weighted losses plus half the squared weights, by C.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiloom.storage import Scratch

# Most terms and least documents of a term for words and characters, sizes of grams, and the strength of the penalty.
WORD_TERMS, WORD_DOCUMENTS, CHAR_TERMS, CHAR_DOCUMENTS, C = 20_000, 2, 40_000, 3, 1.0
CHAR_GRAMS = (3, 4, 5)
#: Characters of texts whose terms a task has in memory at once, and the most rows that a fit takes: those with the smallest hashes of their texts.
SLICE_CHARS, SAMPLE_ROWS = 400_000, 12_000

_WORD, _SPACES = re.compile(r"(?u)\b\w\w+\b"), re.compile(r"\s\s+")
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


_HASHES: dict[str, int] = {}


def _hashed(words: list[str]) -> np.ndarray:
    """64 bits of each word, by a digest; those of words seen lately are kept."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    for x in set(words).difference(_HASHES):
        _HASHES[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    return np.fromiter((_HASHES[x] for x in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(terms sorted, counts) of the words of two or more characters and their pairs."""
    words = _hashed(_WORD.findall(text.lower()))
    pairs = _mixed(_mixed(words[:-1]) ^ words[1:])
    return np.unique(np.concatenate([words, pairs]).view(np.int64), return_counts=True)


def char_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(terms sorted, counts) of the 3 to 5 neighbouring characters, runs of white space being one space."""
    points = np.frombuffer(_SPACES.sub(" ", text.lower()).encode("utf-32-le"), "<u4").astype(np.uint64)
    found = []
    for n in CHAR_GRAMS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = _mixed(h ^ points[k : k + len(h)])
            found.append(h.view(np.int64))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_KINDS = {"word": (word_terms, WORD_TERMS, WORD_DOCUMENTS), "char": (char_terms, CHAR_TERMS, CHAR_DOCUMENTS)}


def _slices(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts of about SLICE_CHARS together; a longer one is alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def term_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, term, documents, occurrences over all rows."""
    names = ["kind", "term", "documents", "occurrences"]

    def run(batches: Iterator[pa.RecordBatch]):
        for texts in _slices(x.as_py() or "" for batch in batches for x in batch.column(0)):
            for kind, (terms_of, *_) in _KINDS.items():
                told = [terms_of(x) for x in texts]
                every, at = np.unique(np.concatenate([t for t, _ in told]), return_inverse=True)
                documents, occurrences = np.bincount(at, minlength=len(every)), np.bincount(at, np.concatenate([c for _, c in told]), minlength=len(every))
                for lo in range(0, len(every), 100_000):
                    part = slice(lo, lo + 100_000)
                    size = len(every[part])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), pa.array(every[part]), pa.array(documents[part].astype(np.int64)), pa.array(occurrences[part].astype(np.int64))], names=names)

    parts = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, term long, documents long, occurrences long")
    return parts.groupBy("kind", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


class TermVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The vectors of texts over a fitted vocabulary: words, characters, and a one."""

    wordTerms = Param(Params._dummy(), "wordTerms", "terms of words", TypeConverters.toListInt)
    wordIdf = Param(Params._dummy(), "wordIdf", "their weights", TypeConverters.toListFloat)
    charTerms = Param(Params._dummy(), "charTerms", "terms of characters", TypeConverters.toListInt)
    charIdf = Param(Params._dummy(), "charIdf", "their weights", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vocabulary = [(_KINDS[k][0], np.array(self.getOrDefault(self.getParam(k + "Terms")), np.int64), np.array(self.getOrDefault(self.getParam(k + "Idf")), float)) for k in _KINDS]
        size = sum(len(terms) for _, terms, _ in vocabulary) + 1
        at, out = dataset.columns.index(self.getInputCol()), self.getOutputCol()

        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            indices, values, first = [], [], 0
            for terms_of, terms, idf in vocabulary:
                own, counts = terms_of(text)
                place = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
                known = terms[place] == own if len(terms) else np.zeros(len(own), bool)
                x = (1 + np.log(counts[known])) * idf[place[known]]
                indices.append(place[known] + first)
                values.append(x / np.sqrt(x @ x) if len(x) else x)
                first += len(terms)
            return np.concatenate([*indices, [first]]).astype(np.int32), np.concatenate([*values, [1.0]])

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    told = [vector(x.as_py() or "") for x in part.column(at)]
                    n = len(told)
                    ends = np.concatenate([[0], np.cumsum([len(i) for i, _ in told])]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))) for flat in zip(*told, strict=True)]
                    vectors = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], fields=list(_VECTOR))
                    yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out])

        return dataset.mapInArrow(run, StructType([*dataset.schema.fields, StructField(out, VectorUDT())]))


def vocabulary(rows: DataFrame, text_col: str = "text") -> TermVectors:
    """The stage fitted on rows: of each kind the most frequent terms (ties: smaller hash) that stand in enough documents."""
    n, counts = rows.count(), term_counts(rows, text_col)
    told = {}
    for kind, (_, most, least) in _KINDS.items():
        top = counts.where((F.col("kind") == kind) & (F.col("documents") >= least)).orderBy(F.desc("occurrences"), "term").limit(most).select("term", "documents").toArrow()
        terms, documents = (top.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(terms)
        told[kind] = (terms[order].tolist(), (np.log((1 + n) / (1 + documents[order])) + 1).tolist())
    stage = TermVectors()
    stage._set(inputCol=text_col, outputCol="features", wordTerms=told["word"][0], wordIdf=told["word"][1], charTerms=told["char"][0], charIdf=told["char"][1])
    return stage


def train(rows: DataFrame, text_col: str = "text", label_col: str = "label", most: int = SAMPLE_ROWS) -> PipelineModel:
    """Fit on the training rows alone, at most ``most`` of them; each class has half of all weight.

    The sample is written to the shared folder, over as many tasks as the session has cores, as each step of the fit reads it.
    """
    spark = rows.sparkSession
    with Scratch(spark) as put:
        rows = rows.select(text_col, label_col).orderBy(F.sha2(F.coalesce(text_col, F.lit("")), 256), label_col).limit(most)
        rows = put(rows.repartition(spark.sparkContext.defaultParallelism), "baseline-sample")
        counts = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
        total = sum(counts.values())
        weight = F.when(F.col(label_col) == 1, total / (2 * counts.get(1, 1))).otherwise(total / (2 * counts.get(0, 1)))
        stage = vocabulary(rows, text_col)
        vectors = stage.transform(rows.select(text_col, label_col, weight.alias("weight"))).select("features", F.col(label_col).cast("double").alias("label"), "weight")
        # MLlib leaves out features that never vary; a row of zeros, whose loss no weight changes, makes the one vary
        size = len(stage.getOrDefault(stage.wordTerms)) + len(stage.getOrDefault(stage.charTerms)) + 1
        zeros = spark.createDataFrame([(Vectors.sparse(size, [], []), 0.0, float(total))], vectors.schema).coalesce(1)
        fit = LogisticRegression(weightCol="weight", regParam=1 / (2 * C * max(total, 1)), maxIter=100, tol=1e-6, fitIntercept=False, standardization=False)
        return PipelineModel([stage, fit.fit(vectors.unionByName(zeros))])


def predict(model: PipelineModel, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with score, the probability of label 1."""
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "score")
