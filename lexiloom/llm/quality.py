"""Quality by ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 toxic, 1 poor quality, 2 good. One weight vector over hashed text
features is shared by all grades; increasing thresholds t_0 < t_1 cut its score s into grades:
P(grade <= k) = logistic(t_k - s). The fit maximises the penalised likelihood of a bounded, labelled
sample; every document is then scored in one map, with its expected grade and the tail probability
P(grade >= 2), by which it is kept or rejected.

Defined results: a null text counts as empty (its only features are those of an empty text); a
document with a null id is scored too, and repeated rows are each scored; a very long text is scored by all its
features; null labels are left out, and a document labelled more than once has its lowest grade; without any usable labels all weights are zero, the tail probability is
that of the smoothed grade counts, and nothing is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.vectext import LOWER, SLICE_BYTES, give_back, mix, slices, span_hashes, utf8, words
from lexiloom.storage import small_batches

#: Hashed features, grades, labelled rows that the fit may use, and features of each: of a longer text those with the least hashes.
FEATURE_BITS, GRADES, SAMPLE_ROWS, SAMPLE_FEATURES = 18, 3, 12_000, 4_096
#: Features in fewer sampled documents keep a weight of zero.
MIN_DOCUMENTS = 20

_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_WORD
_SEED = {name: np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k, name in enumerate(("word", "mark", "shape"))}


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted, of a flat batch of texts.

    Features are the lower-cased words, the runs of two or more marks, and coarse shapes of the
    whole text: the shares of distinct words, of marks, of stand-alone marks and of digits, and
    the mean word length, each in steps.
    """
    n = len(offsets) - 1
    low = LOWER[raw]
    mask = np.uint64((1 << bits) - 1)
    starts, ends, rows = words(low, offsets, ~_WORD)
    hashed = span_hashes(low, starts, ends)
    pairs = [_pairs(rows, hashed ^ _SEED["word"], mask, bits)]
    m_starts, m_ends, m_rows = words(low, offsets, ~_MARK)
    long = m_ends - m_starts > 1
    pairs.append(_pairs(m_rows[long], span_hashes(low, m_starts[long], m_ends[long]) ^ _SEED["mark"], mask, bits))
    sizes = np.maximum(np.diff(offsets), 1)
    counts = np.bincount(rows, minlength=n)
    distinct = np.bincount(np.unique(pairs[0]) >> bits, minlength=n)
    marks = np.bincount(m_rows, weights=m_ends - m_starts, minlength=n)
    alone = np.bincount(m_rows[_alone(low, m_starts, m_ends)], minlength=n)
    letters = np.bincount(rows, weights=ends - starts, minlength=n)
    every = np.arange(n)
    for k, value in enumerate((
        np.floor(10 * distinct / np.maximum(counts, 1)) + 11 * np.minimum(np.log2(counts + 1).astype(int) // 2, 5),
        np.floor(np.minimum(20 * marks / sizes, 12)),
        np.floor(np.minimum(20 * alone / np.maximum(counts, 1), 12)),
        np.floor(np.minimum(letters / np.maximum(counts, 1), 15)),
        np.minimum(np.log2(counts + 1), 12).astype(int),
    )):
        h = (value.astype(np.uint64) + np.uint64(1) + np.uint64(1000 * k)) * np.uint64(0xD6E8FEB86659FD93)
        pairs.append(_pairs(every, (h ^ (h >> np.uint64(31))) ^ _SEED["shape"], mask, bits))
    both = np.unique(np.concatenate(pairs))
    return both >> bits, both & ((1 << bits) - 1)


def _pairs(rows: np.ndarray, hashed: np.ndarray, mask: np.uint64, bits: int) -> np.ndarray:
    return (rows.astype(np.int64) << bits) | (hashed & mask).astype(np.int64)


def _alone(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether white space or an end stands on both sides."""
    if not len(starts):
        return np.zeros(0, bool)
    before = np.where(starts > 0, _SPACE[raw[np.maximum(starts - 1, 0)]], True)
    after = np.where(ends < len(raw), _SPACE[raw[np.minimum(ends, len(raw) - 1)]], True)
    return before & after


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool = True

    def scores(self, rows: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[feature], minlength=n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, by column."""
        return logistic(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.tails(scores).sum(1)


def objective(theta: np.ndarray, rows: np.ndarray, column: np.ndarray, grades: np.ndarray, weight: np.ndarray, ridge: float, levels: int = GRADES) -> tuple[float, np.ndarray]:
    """The penalised negative log-likelihood and its gradient by theta: weights, first threshold, logarithms of the distances of the others."""
    n, used = len(grades), len(theta) - levels + 1
    w, first, gaps = theta[:used], theta[used], theta[used + 1 :]
    cuts = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    s = np.bincount(rows, weights=w[column], minlength=n)
    edges = np.concatenate([np.zeros((n, 1)), logistic(cuts[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
    at = np.arange(n)
    hi, lo = edges[at, grades + 1], edges[at, grades]
    p = np.maximum(hi - lo, 1e-9)
    slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_score = weight * (slope_hi - slope_lo)
    by_cut = np.zeros(levels - 1)
    for k in range(levels - 1):
        by_cut[k] = -(weight[grades == k] * slope_hi[grades == k]).sum() + (weight[grades == k + 1] * slope_lo[grades == k + 1]).sum()
    grad = np.concatenate([
        np.bincount(column, weights=by_score[rows], minlength=used) + ridge * w,
        [by_cut.sum()],
        np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(gaps),
    ])
    return float(-(weight * np.log(p)).sum() + ridge * (w @ w) / 2), grad


def fit(rows: np.ndarray, feature: np.ndarray, grades: np.ndarray, size: int = 1 << FEATURE_BITS, levels: int = GRADES, ridge: float = 0.0002, steps: int = 250, most: float = 2.0, rate: float = 0.05) -> OrdinalModel:
    """Full-batch Adam on the mean penalised log-likelihood; classes weigh alike up to a factor of ``most``.

    Thresholds are kept in order as the first and the logarithms of their distances.
    """
    n = len(grades)
    counts = np.bincount(grades, minlength=levels).astype(float)
    below = (np.cumsum(counts)[:-1] + 1) / (n + levels)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(levels - 1))
    if n == 0 or (counts > 0).sum() < 2:
        return OrdinalModel(np.zeros(size), start, fitted=False)
    used = np.flatnonzero(np.bincount(feature, minlength=size) >= min(MIN_DOCUMENTS, n))
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[feature] >= 0
    rows, column = rows[keep], place[feature[keep]]
    weight = np.minimum(counts.max() / np.maximum(counts, 1), most)[grades]
    weight /= weight.sum()
    w, first, gaps = np.zeros(len(used)), start[0], np.log(np.maximum(np.diff(start), 0.1))
    theta = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = objective(theta, rows, column, grades, weight, ridge, levels)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    weights = np.zeros(size)
    weights[used] = theta[: len(used)]
    first, gaps = theta[len(used)], theta[len(used) + 1 :]
    return OrdinalModel(weights, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return (
        labels.select(F.col(id_col).cast("long").alias(id_col), grade.alias("grade"))
        .where(F.col("grade").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min("grade").alias("grade"))
    )


def sampled_features(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, grade, features array<int> of the ``sample_rows`` graded documents that come first by a hash of their ids.

    The sampled ids have at most ``sample_rows`` rows, so the join broadcasts them.
    """
    small_batches(docs.sparkSession)
    sample = grades.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    joined = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).join(F.broadcast(sample), id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                rows, feature = features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                rows, feature = _bounded(rows, feature, hi - lo)
                ends = np.searchsorted(rows, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], names=[id_col, "grade", "features"])

    return joined.select(id_col, text_col, "grade").mapInArrow(run, f"{id_col} long, grade int, features array<int>")


def _bounded(rows: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE_FEATURES features of each row."""
    if not len(rows) or np.bincount(rows, minlength=n).max() <= SAMPLE_FEATURES:
        return rows, feature
    order = np.lexsort((mix(feature.astype(np.uint64)), rows))
    first = np.searchsorted(rows, rows)
    kept = np.sort(order[np.arange(len(rows)) - first < SAMPLE_FEATURES])
    return rows[kept], feature[kept]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on the bounded sample, on the driver."""
    got = sampled_features(docs, graded(labels, id_col), id_col, text_col, sample_rows).toArrow()
    return fit_table(got)


def fit_table(got: pa.Table) -> OrdinalModel:
    lists = got["features"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), got["grade"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """id, score, expected_grade, tail_probability, keep of every document; one map, no shuffle.

    The model goes out as one broadcast variable of 8 bytes a feature.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.fitted))
    names = [id_col, "score", "expected_grade", "tail_probability", "keep"]

    def run(batches: Iterator[pa.RecordBatch]):
        own = OrdinalModel(*sent.value)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                s = own.scores(*features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), hi - lo)
                tail = own.tails(s)[:, -1]
                keep = tail >= keep_at if own.fitted else np.ones(len(s), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array(own.expected(s)), pa.array(tail), pa.array(keep)], names=names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"{id_col} long, score double, expected_grade double, tail_probability double, keep boolean"
    )


def kept_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns, in one map without a join."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.fitted))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        own = OrdinalModel(*sent.value)
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            for lo, hi in slices(offsets, SLICE_BYTES):
                s = own.scores(*features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), hi - lo)
                if own.fitted:
                    yield batch.slice(lo, hi - lo).filter(pa.array(own.tails(s)[:, -1] >= keep_at))
                else:
                    yield batch.slice(lo, hi - lo)
        give_back()

    return docs.mapInArrow(run, docs.schema)
