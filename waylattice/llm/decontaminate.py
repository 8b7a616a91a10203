"""Benchmark decontamination by winnowing: fingerprints of both sides are joined and hits are extended."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import WordHashes, batch, gram_hashes, materialize, small_batches, table, text_bytes

#: Words of a span that is always found, and words of a fingerprinted gram; the winnowing window is their difference plus one.
SPAN, GRAM = 13, 7
#: Words of benchmark items that one block may hold; a block is held in each Python worker.
BLOCK_WORDS = 2_000_000

#: Bytes to words: A-Z lower-cased, other ASCII but letters and digits as blanks, the bytes of all other characters kept.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of all grams that are the smallest of some run of `window` grams; of a shorter sequence, none."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    most = np.zeros(len(grams), np.uint64)  # the largest of the minima of the runs that hold a position
    for j in range(window):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(grams == most)


class Block:
    """Fingerprints and windows of some benchmark items: some 40 bytes for each word. Windows are compared by their bytes, so that
    no hash decides."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        hashes = WordHashes()
        self.items: list[str] = []
        texts, starts, lengths, fingerprints = [], [], [], []
        found: dict[int, tuple[list, list]] = {}  # by length: hashes and first words of windows
        at, n = 0, 0
        for item, data in items:
            if not (words := words_of(data)):
                continue
            h, length = hashes.of(words), min(span, len(words))
            g = gram_hashes(h, length)
            own = found.setdefault(length, ([], []))
            own[0].append(g)
            own[1].append(np.arange(n, n + len(g)))
            if length == span:
                f = gram_hashes(h, gram)
                fingerprints.append(f[winnowed(f, span - gram + 1)])
            size = np.fromiter(map(len, words), np.int64, len(words))
            starts.append(at + np.r_[0, np.cumsum(size[:-1] + 1)])
            lengths.append(size)
            texts.append(b" ".join(words) + b" ")
            at += len(texts[-1])
            self.items.append(item)
            n += len(words)
        self.text = b"".join(texts)
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.ends = self.starts + (np.concatenate(lengths) if lengths else 0)
        self.first = np.cumsum([0, *map(len, lengths)])  # the first word of each item
        self.fingerprints = np.unique(np.concatenate(fingerprints)) if fingerprints else np.empty(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, (g, i) in found.items():
            g, i = np.concatenate(g), np.concatenate(i).astype(np.int32)
            order = np.argsort(g, kind="stable")
            self.windows[length] = g[order], i[order]

    def items_with(self, length: int, hash_: int, words: list[bytes]) -> set[str]:
        """The items that have these words as a window."""
        keys, at = self.windows[length]
        i = at[np.searchsorted(keys, hash_, "left") : np.searchsorted(keys, hash_, "right")]
        text = b" ".join(words)
        same = [w for w in i.tolist() if self.text[self.starts[w] : self.ends[w + length - 1]] == text]
        return {self.items[x] for x in np.unique(np.searchsorted(self.first, same, "right") - 1).tolist()}

    @staticmethod
    def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x

    def search(self, words: list[bytes], h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that some window covers, joined where they touch, and the items of these windows."""
        starts: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, (keys, _) in self.windows.items():
            if len(words) < length:
                continue
            if length == self.span:
                g = gram_hashes(h, self.gram)
                at = winnowed(g, self.span - self.gram + 1)
                at = at[self.among(g[at], self.fingerprints)]
                if not len(at):
                    continue
                near = np.zeros(len(words) - length + 1, bool)  # windows that hold a hit
                for j in range(self.span - self.gram + 1):
                    i = at - j
                    near[i[(i >= 0) & (i < len(near))]] = True
                at = np.flatnonzero(near)
                grams = gram_hashes(h, length)[at]
            else:
                grams = gram_hashes(h, length)
                at = np.arange(len(grams))
            found = self.among(grams, keys)
            seen: dict[int, tuple[list[bytes], set[str]]] = {}  # windows that repeat in this text are looked up once
            for i, x in zip(at[found].tolist(), grams[found], strict=True):
                w = words[i : i + length]
                known = seen.get(int(x))
                if known is None or known[0] != w:
                    known = seen[int(x)] = w, self.items_with(length, x, w)
                if known[1]:
                    starts.append((i, i + length))
                    items |= known[1]
        spans: list[tuple[int, int]] = []
        for s, e in sorted(starts):
            if spans and s <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(e, spans[-1][1])
            else:
                spans.append((s, e))
        return spans, items


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
FOUND = [StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]
ARROW = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
#: Joins sorted spans where they touch.
JOINED = """aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (a, x) ->
  if(size(a) > 0 and x.start <= element_at(a, -1).end,
     concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
     concat(a, array(x))))"""


def pack(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Parts put together, in order, as long as no more than `most` words come together."""
    out, held = [], math.inf
    for p in sorted(sizes):
        if held + sizes[p] > most:
            out.append([])
            held = 0
        out[-1].append(p)
        held += sizes[p]
    return out


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), span: int = SPAN, gram: int = GRAM, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Words of documents inside any occurrence of a benchmark window: span consecutive words of an item, or all of a shorter one.

    Returns one row per input row: the columns named in carry, n_words, spans (start and end word, end excluded), items
    (item ids as strings, sorted). A carried column named like one of these is left out.

    Winnowing keeps the smallest gram hash of every span - gram + 1 grams on both sides, so any shared span of `span`
    words shares a fingerprint. Fingerprints are joined in memory, and each hit is extended to all windows that hold it,
    which are then compared word by word. Different items and texts of the benchmark are packed into blocks of block_words words;
    a block holds more only where one item, or the items of one of many hash values, has more. Documents pass once by each
    block, so the memory of a worker is bounded whatever the benchmark's size. With one block, the usual case, nothing is shuffled.

    * A null or empty text has no words and no spans; an item without words has no windows; a null item id is the empty string.
    * Rows may repeat in either table: each document row gets a row, and an item id counts once for a document.
    * An empty table of documents gives an empty result; with an empty benchmark no row has spans.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = tuple(c for c in carry if c not in ("n_words", "spans", "items"))
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text")).distinct()
    most = F.ceil((F.length("text") + 1) / 2)  # no more words than every second byte
    total = bench.agg(F.sum(most)).first()[0] or 0
    parts = 1 if total <= block_words else 64 * math.ceil(total / block_words)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    packed = pack(dict(bench.groupBy(part.alias("part")).agg(F.sum(most)).collect()), block_words) if parts > 1 else [[0]]
    blocks = len(packed)
    source = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)], text_bytes(text_col).alias("text_"))
    kept = source.schema.fields[:-1]

    def scan(shared, keep: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, block = WordHashes(), shared.value
            for b in batches:
                counts, spans, items = [], [], []
                for data in b.column("text_").to_pylist():
                    words = words_of(data)
                    found, of = block.search(words, hashes.of(words)) if words else ([], set())
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in found])
                    items.append(sorted(of))
                new = [pa.array(x, t) for x, t in zip((counts, spans, items), ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, "n_words", "spans", "items"])

        return run

    def load(k: int):
        own = bench if parts == 1 else bench.where(part.isin(packed[k]))
        return spark.sparkContext.broadcast(Block([(r[0], bytes(r[1])) for r in own.toLocalIterator()], span, gram))

    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(carry)]
    if blocks == 1:
        return source.mapInArrow(scan(load(0), [f.name for f in kept]), StructType([*kept, *FOUND])).select(*names, "n_words", "spans", "items")
    rows = materialize(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = None
    for k in range(blocks):
        one = rows.select("row", "text_").mapInArrow(scan(load(k), ["row"]), StructType([StructField("row", LongType()), *FOUND]))
        one = materialize(one if k == 0 else one.where(F.size("spans") > 0), "decontaminate-block")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.drop("text_").join(merged.withColumn("spans", F.expr(JOINED)), "row").select(*names, "n_words", "spans", "items")


def contamination(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (at least a twentieth of the words, and one) to rows of find_spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bw),
dw AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
dg AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM dw),
h AS (SELECT dg.r, dg.i, dg.k, g.item_id FROM dg JOIN g USING (k, g)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
