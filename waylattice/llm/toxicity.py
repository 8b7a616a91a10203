"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton in folded text."""

from __future__ import annotations

import bisect
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import crc_mod, materialize, small_batches, table, text_bytes

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters. i and l are one letter here, as 1 stands for both.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x", "ı": "i", "ſ": "s", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
}

class Folding(dict):
    """A table for str.translate that folds a character when it is first seen."""

    def __missing__(self, code: int):
        c = chr(code)
        out = []
        for x in unicodedata.normalize("NFKC", c).lower():
            x = LOOKALIKES.get(x, x)
            if unicodedata.category(x) in ("Cf", "Mn"):  # zero width, combining
                continue
            out.append(x if x.isalpha() else " ")
        self[code] = value = "".join(out)
        return value


def folded(text: str, table_: Folding) -> str:
    """Folded words with one blank around each."""
    return f" {' '.join(text.translate(table_).split())} "


@dataclass(frozen=True)
class LexiconConfig:
    """sample: labelled rows of each class, about, that the lexicon is learned from. least_odds: log odds ratio that a pattern must have.
    least_evidence: log likelihood ratio, in nats, between its two rates and one for both. prefix: lengths of word beginnings
    that may be patterns."""

    sample: int = 20_000
    least_odds: float = 3.0
    least_evidence: float = 8.0
    prefix: tuple[int, int] = (3, 8)


#: Counts of patterns that a task holds before it passes them on.
COUNTED = 500_000


def patterns_of(text: str, prefix: tuple[int, int]) -> set[str]:
    """Whole words, with a blank on either side, and beginnings of words, with a blank before."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(prefix[0], min(prefix[1], len(w) - 1) + 1))
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.weights = weights
        self.fold = Folding()
        self.automaton = ahocorasick.Automaton()
        for p, w in weights.items():
            self.automaton.add_word(p, (len(p), w))
        for e in exceptions:
            p = folded(e, self.fold)
            self.automaton.add_word(p, (len(p), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, t: str) -> dict[int, float]:
        """Of folded text: the places before words that some pattern begins, outside exception phrases, with the best pattern's weight."""
        at: dict[int, float] = {}
        masked: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(t) if self.weights else ():
            start = end - size + 1
            if w is None:
                masked.append((start, end))
            elif w > at.get(start, 0):
                at[start] = w
        starts, k = sorted(at) if masked else [], 0
        for s, e in sorted(masked):  # by their beginnings, so that no place is looked at twice
            k = bisect.bisect_left(starts, s, k)
            while k < len(starts) and starts[k] < e:
                del at[starts[k]]
                k += 1
        return at

    def match(self, text: str) -> tuple[float, int, int]:
        """Sum of the weights of words that some pattern begins, each word once by its best pattern; such words; all words."""
        t = folded(text, self.fold)
        at = self.hits(t)
        return float(sum(at.values())), len(at), t.count(" ") - 1 if t.strip() else 0

    def phrases(self, text: str) -> set[str]:
        """Each word that is hit, with the word before it and with the one after it; and the empty phrase if there is any."""
        t = folded(text, self.fold)
        found = self.hits(t)
        out = {""} if found else set()
        for i in found:
            end = t.index(" ", i + 1)
            if i:
                out.add(t[t.rindex(" ", 0, i) + 1 : end])
            if end < len(t) - 1:
                out.add(t[i + 1 : t.index(" ", end + 1)])
        return out


def evidence(t: Column, c: Column, toxic: int, clean: int) -> tuple[Column, Column]:
    """The log odds ratio of t of `toxic` and c of `clean` texts, and the log likelihood ratio of two rates against one."""
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    part = lambda n, of: F.when(n > 0, n * F.log(n * (toxic + clean) / ((t + c) * of))).otherwise(0.0)
    return odds, part(t, float(max(toxic, 1))) + part(c, float(max(clean, 1)))


def choose_patterns(rows: list[tuple[str, float, int]]) -> dict[str, float]:
    """Weights of patterns from (pattern, log odds ratio, toxic texts). A beginning that is as telling replaces all patterns that it
    begins; a pattern that begins one of more texts and the same odds goes first."""
    chosen: dict[str, float] = {}
    for p, odds, _ in sorted(rows, key=lambda r: (-r[1], -r[2], len(r[0]), r[0])):
        if not any(p[:k] in chosen for k in range(2, len(p))):
            chosen[p] = odds
    return chosen


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the weights of a constant and the columns of x."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def measures(total: np.ndarray, found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the score is made of: the weight found, and the weight in a hundred words."""
    return np.c_[np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), np.minimum(found, 5)]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, train_mask, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", config: LexiconConfig = LexiconConfig(), exceptions: tuple[str, ...] = ()
) -> DataFrame:
    """Learn a weighted lexicon from labelled rows of train_mask, and score all whole texts.

    Returns one row per input row: id_col, trained (the mask), score, weight, n_found, n_words. Scores depend on the text alone.

    The lexicon is learned from about config.sample rows of each class, those whose ids hash lowest, so what is joined and
    counted for it is bounded; equal texts count once. Its patterns are words and beginnings of words in toxic texts,
    weighed by their log odds ratio; every one with enough odds and evidence is taken, so their number is bounded by the
    sample alone. Exception phrases are those given, and pairs of words with a match inside that, of
    texts with a match, are as telling of clean ones. A text is folded (case, look-alike letters, digits for letters, zero-width characters), matched in one pass by
    an automaton, matches inside exception phrases are taken out, and weight and weight by length are turned into a
    probability by a logistic regression on the same sample.

    * A null or empty text has no matches, and the score that goes with none. A null id is never trained on.
    * Rows may repeat in both tables; a text with both labels counts in both classes. Other labels than 0 and 1 are left out.
    * Without toxic labels the lexicon is empty and all scores are 0.
    * An empty table gives an empty result. Texts may be of any length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), train_mask.alias("trained"), text_bytes(text_col).alias("text"))
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label_")).where(F.col("label_").isin(0, 1) & F.col(id_col).isNotNull()).distinct()
    marked = marked.where(train_mask).select(F.col(id_col).alias("id"), F.col("label_").alias("label"))
    of_class = dict(marked.groupBy("label").count().collect())
    share = F.when(F.col("label") == 1, min(1.0, config.sample / of_class.get(1, 1))).otherwise(min(1.0, config.sample / of_class.get(0, 1)))
    chosen = materialize(marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)), "toxicity-sample")  # about 2 * sample rows of 12 bytes
    texts = materialize(source.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("key"), "label").agg(F.first("text").alias("text")).select("label", "text"), "toxicity-texts")
    sizes = dict(texts.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = StructType([texts.schema["label"], StructField("pattern", StringType()), StructField("n", LongType())])

    def count(found_in):
        """How many texts of each class have each pattern."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, counts = found_in(), Counter()

            def out() -> pa.RecordBatch:
                own = list(counts.items())
                counts.clear()
                return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in own], pa.int32()), pa.array([k[1] for k, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=counted.names)

            for b in batches:
                for label, x in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                    counts.update((label, p) for p in find(x.decode("utf-8", "replace")))
                if len(counts) > COUNTED:
                    yield out()
            yield out()

        return texts.mapInArrow(run, counted).groupBy("pattern").agg(*[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "t"), (0, "c"))])

    def telling(sums: DataFrame, toxic: int, clean: int) -> DataFrame:
        odds, proof = evidence(F.col("t"), F.col("c"), toxic, clean)
        return sums.withColumn("odds", odds).where((F.abs("odds") >= config.least_odds) & (proof >= config.least_evidence))

    def patterns():
        fold = Folding()
        return lambda text: patterns_of(folded(text, fold), config.prefix)

    weights = choose_patterns([tuple(r) for r in telling(count(patterns), toxic, clean).where("odds > 0").select("pattern", "odds", "t").toLocalIterator()]) if toxic and clean else {}
    if weights:
        given = spark.sparkContext.broadcast((weights, exceptions))
        found = materialize(count(lambda: Lexicon(*given.value).phrases), "toxicity-phrases", 0)
        hit = found.where("pattern = ''").select("t", "c").first() or (0, 0)
        learned = telling(found.where("pattern <> ''"), *hit).where("odds < 0").select("pattern").toLocalIterator()
        exceptions = (*exceptions, *sorted(r[0] for r in learned))
    shared = spark.sparkContext.broadcast((weights, exceptions))
    matched = [StructField("total", DoubleType()), StructField("found", LongType()), StructField("words", LongType())]

    def match(keep: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(*shared.value)
            for b in batches:
                m = [lexicon.match(x.decode("utf-8", "replace")) for x in b.column("text").to_pylist()]
                cols = [pa.array([r[i] for r in m], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "total", "found", "words"])

        return run

    w = np.zeros(4)
    if weights:
        seen = texts.mapInArrow(match(("label",)), StructType([texts.schema["label"], *matched])).toArrow()
        w = calibrate(measures(*(seen.column(c).to_numpy() for c in ("total", "found", "words"))), seen.column("label").to_numpy().astype(float))
    scored = source.mapInArrow(match(("id", "trained")), StructType([source.schema["id"], source.schema["trained"], *matched]))
    z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.log1p("total") + F.lit(float(w[2])) * F.log1p(100 * F.col("total") / F.greatest("words", F.lit(1))) + F.lit(float(w[3])) * F.least("found", F.lit(5))
    score = 1 / (1 + F.exp(-z)) if weights else F.lit(0.0)
    return scored.select(F.col("id").alias(id_col), "trained", score.alias("score"), F.col("total").alias("weight"), F.col("found").alias("n_found"), F.col("words").alias("n_words"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(5) != 0)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
