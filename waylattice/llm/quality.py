"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import crc_mod, materialize, native_filter, small_batches, table, text_bytes

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:'-"
_OTHER = bytes(b for b in range(33, 127) if b not in _LOWER + _UPPER + _DIGIT + _STOPS + b"!|?")
_NOT_LETTERS = bytes(b for b in range(128) if b not in _LOWER + _UPPER)

FEATURES = (
    "words", "word_length", "word_length_spread", "upper", "stops", "symbols", "bars", "marks", "digits", "distinct", "most_frequent", "repeated_pairs", "short_words",
    "lines", "repeated_lines", "letterless", "capitals", "most_frequent_run",
)


#: Words, bytes and lines of usual text that are added to a text, so that the rates of a short one are near the usual rates.
EXTRA_WORDS, EXTRA_BYTES, EXTRA_LINES = 40, 250, 10


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of a text; rates go through asinh, which is linear near 0 and a logarithm beyond."""
    words = data.split()
    n, size, w = len(words), len(data), EXTRA_WORDS
    part = lambda chars: size - len(data.translate(None, chars))
    upper, lower = part(_UPPER), part(_LOWER)
    lengths = np.fromiter(map(len, words), np.float64, n) if words else np.zeros(0)
    counts = Counter(words)
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    run = best = 1
    if pairs:
        for a, b in zip(words, words[1:], strict=False):
            run = run + 1 if a == b else 1
            best = max(best, run)
    lines = data.split(b"\n")
    mean = (lengths.sum() + 6 * w) / (n + w)
    spread = (((lengths - mean) ** 2).sum() + 12 * w) / (n + w)
    rate = lambda x, usual, of, extra, scale=50.0: float(np.arcsinh(scale * (x + usual * extra) / (of + extra)))
    bytes_ = lambda x, usual: rate(x, usual, size, EXTRA_BYTES)
    return [
        float(np.log1p(n + w)),
        float(np.log(mean)),
        float(np.log(spread) / 2),
        rate(upper, 0.03, upper + lower, EXTRA_BYTES),
        bytes_(part(_STOPS), 0.03),
        bytes_(part(_OTHER), 0.0),
        bytes_(data.count(b"|"), 0.0),
        bytes_(part(b"!?"), 0.0),
        bytes_(part(_DIGIT), 0.0),
        float(np.log((len(counts) + 0.7 * w) / (n + w))),
        rate(counts.most_common(1)[0][1] if words else 0, 0.05, n, w, 10.0),
        rate(pairs, 0.0, n, w),
        rate(float((lengths <= 3).sum()), 0.35, n, w, 5.0),
        rate(len(lines), 0.05, n, w),
        rate(len(lines) - len(set(lines)), 0.0, len(lines), EXTRA_LINES, 5.0),
        rate(sum(not x.translate(None, _NOT_LETTERS) for x in words), 0.02, n, w),
        rate(sum(x.isupper() for x in words), 0.02, n, w),
        float(np.log(max(best, 2))),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes in standardised statistics, each with its inverse Cholesky factor and log-determinant."""

    mean: np.ndarray
    scale: np.ndarray
    centres: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        z = (x - self.mean) / self.scale
        density = [k - 0.5 * (((z - c) @ f.T) ** 2).sum(axis=1) for c, f, k in zip(self.centres, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1, floor: float = 1e-3) -> Discriminant | float:
    """From count, sum and sum of products of each class. Class covariances shrink towards their diagonal, and `floor` of
    the variance of all rows is added to every variance. With rows of one class only, or none, a constant: 1, 0 or 0.5."""
    have = {c: s for c, s in sums.items() if s[0] >= 2}
    if len(have) < 2:
        return {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(have)]
    total = sum(s[0] for s in have.values())
    mean = sum(s[1] for s in have.values()) / total
    variance = np.diag(sum(s[2] for s in have.values()) / total - np.outer(mean, mean))
    scale = np.sqrt(np.maximum(variance, 1e-8))
    centres, factors, constants = [], [], []
    for c in (0, 1):
        n, s, ss = have[c]
        m = s / n
        cov = (ss / n - np.outer(m, m)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.maximum(np.diag(cov), 0)) + floor * np.eye(len(m))
        low = np.linalg.cholesky(cov)
        centres.append((m - mean) / scale)
        factors.append(np.linalg.inv(low))
        constants.append(float(np.log(n / total) - np.log(np.diag(low)).sum()))
    return Discriminant(mean, scale, tuple(centres), tuple(factors), tuple(constants))


def statistics_table(docs: DataFrame, train_mask, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, trained (the mask) and x, the statistics, of every row; kept as a table, as they are some bytes of whole texts."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), train_mask.alias("trained"), text_bytes(text_col).alias("text"))
    kept = source.schema.fields[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("trained"), x], names=["id", "trained", "x"])

    return materialize(source.mapInArrow(run, StructType([*kept, StructField("x", ArrayType(DoubleType()))])), "quality-statistics")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that labels may have, and some others, by a filter of bounded size; nothing is shuffled. For a fit that needs no more."""
    ids = labels.select(F.xxhash64(F.col(id_col).cast(docs.schema[id_col].dataType)).alias("key"))
    return docs.where(native_filter(ids, ids.count())(F.xxhash64(id_col)))


def fit_quality(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant | float:
    """Fit to all trained rows that labels marks 0 or 1. Only counts, sums and sums of products come together, summed in each task first."""
    d = len(FEATURES)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
            y = b.column("label").to_numpy()
            for c in (0, 1):
                z = x[y == c]
                acc[c] += np.r_[len(z), z.sum(axis=0), (z.T @ z).ravel()]
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(acc[c]), c, np.int32)), pa.array(np.arange(len(acc[c]))), pa.array(acc[c])], names=["label", "at", "value"])

    schema = StructType([StructField("label", IntegerType()), StructField("at", LongType()), StructField("value", DoubleType())])
    got = stats.where("trained").select("id", "x").join(marked, "id").select("label", "x").mapInArrow(sums, schema).groupBy("label", "at").agg(F.sum("value").alias("value")).toArrow()
    sums_: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for c in (0, 1):
        v = np.zeros(1 + d + d * d)
        own = got.column("label").to_numpy() == c
        v[got.column("at").to_numpy()[own]] = got.column("value").to_numpy()[own]
        sums_[c] = v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)
    return fit(sums_)


def scores_of(model: Discriminant | float, x: np.ndarray) -> np.ndarray:
    return model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)


def quality_scores(docs: DataFrame, labels: DataFrame, train_mask, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts for quality; fitted on the rows of train_mask that labels marks 0 or 1.

    Returns one row per input row: id_col, trained (the mask), score. Scores depend on the text alone.

    * A null text is empty; empty texts have statistics, and so a score. A null id is never trained on.
    * Rows may repeat in both tables: each pair of a text and a label counts. Labels other than 0 and 1 are left out.
    * Without rows of both classes the score is constant (fit). An empty table gives an empty result.
    """
    stats = statistics_table(docs, train_mask, id_col, text_col)
    model = fit_quality(stats, labels, label_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("trained"), pa.array(scores_of(model, x))], names=["id", "trained", "score"])

    return stats.mapInArrow(run, StructType([*stats.schema.fields[:2], StructField("score", DoubleType())])).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Discriminant | float, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores `least` or more."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            x = np.array([statistics((t or "").encode("utf-8", "surrogatepass")) for t in texts]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(scores_of(model, x) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(4) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
